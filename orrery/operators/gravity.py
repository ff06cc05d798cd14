"""Analysis of the weighted graph of worlds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import scalars as S
from orrery.operators.resolve import first_wins
from orrery.tables import stored

SWEEPS = 100


def world_links(nodes: DataFrame, cross_edges: DataFrame) -> DataFrame:
    """(a, b, weight) of each cross edge by its ends' worlds; edges with an unknown end are dropped."""
    order = ["seq"] if "seq" in nodes.columns else ["world"]
    worlds = first_wins(nodes.select("id", *dict.fromkeys(["world", *order])), ["id"], order).select("id", "world")
    out = cross_edges.join(worlds.select(F.col("id").alias("src"), F.col("world").alias("a")), "src")
    out = out.join(worlds.select(F.col("id").alias("dst"), F.col("world").alias("b")), "dst")
    return out.select("a", "b", S.weight(F.col("protocol")).alias("weight"))


def adjacency(links: DataFrame) -> DataFrame:
    """Total weight per unordered pair a < b of different worlds."""
    return links.where("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))


def mass(worlds: DataFrame, adjacent: DataFrame) -> DataFrame:
    """Weighted degree of every world, heaviest first; a world without links has 0."""
    ends = adjacent.select(F.explode(F.array("a", "b")).alias("world"), "weight").groupBy("world").agg(F.sum("weight").alias("mass"))
    every = worlds.select("world").union(ends.select("world")).distinct()
    return every.join(ends, "world", "left").select("world", F.coalesce("mass", F.lit(0.0)).alias("mass")).orderBy(F.desc("mass"), "world")


def density(worlds: DataFrame, adjacent: DataFrame) -> DataFrame:
    """One row: worlds, linked pairs, and their share of all pairs."""
    n = worlds.select("world").union(adjacent.select(F.explode(F.array("a", "b")).alias("world"))).distinct().agg(F.count("*").alias("n_worlds"))
    pairs = adjacent.agg(F.count("*").alias("pair_edges"))
    possible = F.col("n_worlds") * (F.col("n_worlds") - 1) / F.lit(2.0)
    return n.join(F.broadcast(pairs)).select("n_worlds", "pair_edges", F.when(F.col("n_worlds") < 2, F.lit(0.0)).otherwise(F.col("pair_edges") / F.nullif(possible, F.lit(0.0))).alias("density"))


def modularity(adjacent: DataFrame, communities: DataFrame) -> DataFrame:
    """One row with Q of the partition (world, community)."""
    c = communities.select("world", "community")
    both = adjacent.join(c.select(F.col("world").alias("a"), F.col("community").alias("ca")), "a").join(c.select(F.col("world").alias("b"), F.col("community").alias("cb")), "b")
    parts = both.select(F.explode(F.array(
        F.struct(F.col("ca").alias("community"), F.col("weight").alias("degree"), F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0).alias("inner")),
        F.struct(F.col("cb").alias("community"), F.col("weight").alias("degree"), F.lit(0.0).alias("inner")),
    )).alias("x")).select("x.*")
    per = parts.groupBy("community").agg(F.sum("degree").alias("d"), F.sum("inner").alias("l"))
    total = adjacent.agg(F.sum("weight").alias("m"))
    terms = per.join(F.broadcast(total)).select((F.col("l") / F.nullif(F.col("m"), F.lit(0.0)) - F.pow(F.col("d") / F.nullif(2 * F.col("m"), F.lit(0.0)), F.lit(2.0))).alias("t"))
    return terms.agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("modularity"))


def local_moves(worlds: list[str], a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Community of each of ``worlds`` (sorted), as the place of the world that names it.

    ``a``, ``b`` and ``weight`` are undirected links by place. Worlds are visited in
    order, again and again until a sweep moves none. A visit scores the labels of the
    world's links and its own by link weight less the label's share of all weight, and
    takes the highest; the world's own place counts as a label of score 0, whoever
    bears it, and equal scores go to the lesser place. Weights are halves, so sums are
    exact and equal scores are real ties.
    """
    n = len(worlds)
    ends, others, weights = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([weight, weight])
    order = np.argsort(ends, kind="stable")
    ends, others, weights = ends[order], others[order], weights[order]
    first = np.searchsorted(ends, np.arange(n + 1))
    degree = np.bincount(ends, weights, n) if len(ends) else np.zeros(n)
    label, held = np.arange(n), degree.copy()
    whole = degree.sum()
    linked = np.flatnonzero(degree)
    for _ in range(SWEEPS if whole else 0):
        before = label.copy()
        for i in linked:
            held[label[i]] -= degree[i]
            near = slice(first[i], first[i + 1])
            seen, place = np.unique(np.append(label[others[near]], label[i]), return_inverse=True)
            score = np.bincount(place, np.append(weights[near], 0.0)) - held[seen] * degree[i] / whole
            seen, score = np.append(seen, i), np.append(score, 0.0)
            label[i] = seen[score == score.max()].min()
            held[label[i]] += degree[i]
        if (label == before).all():
            break
    return label


def communities(worlds: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(world, community). Local moving is sequential by definition, so the graph of
    worlds (repositories, not files) is handled by one task; everything before it
    is aggregated to one row per pair of worlds."""
    rows = adjacent.select("a", "b", "weight").union(worlds.select(F.col("world").alias("a"), F.lit(None).cast("string"), F.lit(0.0)))

    def move(pdf):
        links = pdf[pdf["b"].notna()]
        names = sorted({*pdf["a"], *links["b"]})
        place = {w: i for i, w in enumerate(names)}
        label = local_moves(names, links["a"].map(place).to_numpy(int), links["b"].map(place).to_numpy(int), links["weight"].to_numpy(float))
        return type(pdf)({"world": names, "community": [names[k] for k in label]})

    return rows.withColumn("graph", F.lit(1)).groupBy("graph").applyInPandas(move, "world string, community string")


def galaxies(found: DataFrame) -> DataFrame:
    """Members per community, sorted; the largest first, then by first member."""
    groups = found.groupBy("community").agg(F.array_sort(F.collect_list("world")).alias("members"))
    return groups.select("members", F.size("members").alias("size")).orderBy(F.desc("size"), F.element_at("members", 1))


def report(nodes: DataFrame, cross_edges: DataFrame, worlds: DataFrame | None = None) -> DataFrame:
    """One row: worlds by mass, galaxies, modularity, pair_edges, density, black_hole."""
    every = nodes.select("world").distinct() if worlds is None else worlds.select("world").union(nodes.select("world")).distinct()
    return report_of(every, adjacency(world_links(nodes, cross_edges)))


def report_of(worlds: DataFrame, adjacent: DataFrame) -> DataFrame:
    worlds, adjacent = stored(worlds, "worlds"), stored(adjacent, "adjacency")
    found = stored(communities(worlds, adjacent), "communities")
    ranked = mass(worlds, adjacent).agg(F.array_sort(F.collect_list(F.struct((-F.col("mass")).alias("m"), "world"))).alias("w"))
    ranked = ranked.select(F.transform("w", lambda x: F.struct(x["world"].alias("world"), (-x["m"]).alias("mass"))).alias("worlds"))
    groups = galaxies(found).agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), "members"))).alias("g"))
    groups = groups.select(F.transform("g", lambda x: x["members"]).alias("galaxies"))
    one = ranked.join(groups).join(modularity(adjacent, found)).join(density(worlds, adjacent))
    hole = (F.col("n_worlds") >= 4) & (F.col("density") >= 0.5) & (F.col("modularity") < 0.2)
    return one.select("worlds", "galaxies", S.round4(F.col("modularity")).alias("modularity"), F.col("pair_edges").cast("int").alias("pair_edges"), S.round4(F.col("density")).alias("density"), hole.alias("black_hole"))
