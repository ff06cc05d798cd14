"""Cross edges: directed key joins and capped symmetric joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery import model
from orrery.functions import scalars as S

COLUMNS = ["src", "dst", "rel", "protocol", "contract_key", "confidence"]


def directional(nodes: DataFrame) -> DataFrame:
    """One edge per pair of a producer and a consumer of one key in two worlds.

    Noise goes below the join. Both sides are projected from one scan; a popular
    key is a skewed join that adaptive execution splits.
    """
    spark = nodes.sparkSession
    pairs = spark.createDataFrame(model.PAIRINGS, "producer string, consumer string, rel string, protocol string, confidence double, forward boolean")
    keyed = nodes.where(~S.is_noise(F.col("kind"), F.col("name"))).select("id", "world", "kind", "name")
    made = keyed.join(F.broadcast(pairs), F.col("kind") == F.col("producer")).select(F.col("id").alias("pid"), F.col("world").alias("pworld"), "name", "rel", "protocol", "confidence", "forward")
    used = keyed.join(F.broadcast(pairs.select("consumer", F.col("protocol").alias("cproto"))), F.col("kind") == F.col("consumer")).select(F.col("id").alias("cid"), F.col("world").alias("cworld"), F.col("name").alias("cname"), "cproto")
    both = made.join(used, (F.col("name") == F.col("cname")) & (F.col("protocol") == F.col("cproto")) & (F.col("pworld") != F.col("cworld")))
    return both.select(
        F.when(F.col("forward"), F.col("pid")).otherwise(F.col("cid")).alias("src"),
        F.when(F.col("forward"), F.col("cid")).otherwise(F.col("pid")).alias("dst"),
        "rel", "protocol", F.col("name").alias("contract_key"), "confidence",
    )


def symmetric(nodes: DataFrame, most: int = model.MOST_WORLDS) -> DataFrame:
    """One edge per pair of worlds that share a key, between their least nodes.

    Keys of under two or over ``most`` worlds link nothing. They are dropped by a
    count before any pairing; what is left has at most most * (most - 1) / 2 pairs
    per key, made inside its row. Representatives combine before the first shuffle;
    they are dealt by key once, for the count, its join and the pairing.
    """
    spark = nodes.sparkSession
    kinds = spark.createDataFrame(model.SYMMETRIC, "kind string, rel string, protocol string, confidence double")
    linking = nodes.where(F.col("kind").isin(*[k[0] for k in model.SYMMETRIC]) & ~S.is_noise(F.col("kind"), F.col("name")))
    reps = linking.groupBy("kind", "name", "world").agg(F.min("id").alias("id")).repartition("kind", "name")
    few = reps.groupBy("kind", "name").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("kind", "name")
    w = reps.join(few, ["kind", "name"], "left_semi").groupBy("kind", "name").agg(F.array_sort(F.collect_list(F.struct("world", "id"))).alias("w"))
    pairs = F.flatten(F.transform(F.col("w"), lambda a: F.transform(F.filter(F.col("w"), lambda b: b["world"] > a["world"]), lambda b: F.struct(a["id"].alias("src"), b["id"].alias("dst")))))
    found = w.select("kind", "name", F.explode(pairs).alias("p")).join(F.broadcast(kinds), "kind")
    return found.select("p.src", "p.dst", "rel", "protocol", F.col("name").alias("contract_key"), "confidence")


def resolve(nodes: DataFrame) -> DataFrame:
    """All cross edges of a graph's nodes."""
    return directional(nodes).unionByName(symmetric(nodes))


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; a minimum over structs, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    if not rest:
        return rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("first")).select(*key, "first.*").select(rows.columns)
    picked = rows.groupBy(*key).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("first"))
    return picked.select(*key, "first.*").select(rows.columns)


def unique_references(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges of those references that name exactly one symbol of a kind they accept.

    ``symbols``: id, world, kind, lookup. ``refs``: world, src, target, rel.
    """
    accepts = symbols.sparkSession.createDataFrame(model.ACCEPTS, "rel string, kind string")
    usable = symbols.join(F.broadcast(accepts), "kind")
    sole = usable.groupBy("world", "lookup", "rel").agg(F.count("*").alias("n"), F.min("id").alias("dst")).where("n = 1")
    met = refs.join(sole, (refs.world == sole.world) & (refs.target == sole.lookup) & (refs.rel == sole.rel)).where(F.col("src") != F.col("dst"))
    return met.select("src", "dst", refs.rel).distinct()


def contains_edges(nodes: DataFrame) -> DataFrame:
    """file -> node, for every node that isn't a file."""
    return nodes.where("kind != 'file'").select(F.concat_ws("::", "world", "rel_path").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("rel"))


def merge(*graphs: DataFrame) -> DataFrame:
    """Union of all rows; nothing is deduplicated."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out


__all__ = ["COLUMNS", "contains_edges", "directional", "first_wins", "merge", "resolve", "symmetric", "unique_references"]
