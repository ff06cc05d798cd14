"""MinHash near-dedup with DartMinHash signatures.

A text is a weighted set: its shingles of ``SHINGLE`` words (letters and digits,
case folded), weighted by how often they occur. Each unit of an element's weight
is a region; per region and unit of rank a hash throws a Poisson(1) number of
darts, and those below the rank bound t / total weight count, so about t darts
fall in a text whatever its length. A dart's hash deals it to one of ``COORDS``
coordinates, each of which keeps its earliest dart. Two texts agree in a
coordinate with probability equal to their weighted Jaccard similarity. If a
coordinate stays empty the text throws again with twice the bound, which adds
darts and moves none.

Signatures are joined by ``BANDS`` bands of ``COORDS // BANDS`` coordinates: at a
similarity of 0.8 a pair meets in no band with probability 6e-5. Texts that are
equal word by word (by 128 bits of hash) are one node from the start. In each bucket
the node with the most companions leads, and each node is compared with the best
leader it has; rounds with other leaders follow for buckets that still hold several
components, while they link enough. What such buckets hold then is joined by
prefixes (``crossing``): regions are ranked by how rare they are, and two texts
similar enough share one among the first of both, so no pair of different
components is left out, and texts that share only what is common never meet. Those
that meet must also be near enough by sketches, which bound how many regions one of
them alone has. Each candidate is verified by its weighted Jaccard similarity, over
32 bits of hash of each region.

A round compares one pair per node at most, whatever the size of its groups, and
its links are contracted at once: the next round sees components. All tables of a
round stay in the shared checkpoint folder. Groups are only ever counted, led by a
maximum, or joined to one row per bucket (skewed joins that adaptive execution can
split): none is gathered.

Edge cases: texts of under ``SHINGLE`` words are one shingle; texts without words
(null, empty, signs only) and rows with a null key form no groups: class_id is
their own key. Repeated rows come back as often as they came, in one class; of a key
with several texts each text has its own class; an empty table gives no rows; other
columns are not read. Class ids are the least key of a class.
"""

from __future__ import annotations

from functools import reduce
from math import exp, factorial, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import ROW, checkpointed, drop, row_hash, sized, without_rows
from orrery.llm.text import BASE, alnum_table, code_points, map_texts, mix, span_hashes, spans

SHINGLE = 5
SIMILAR = 0.8
COORDS = 192
BANDS = 32
#: Leader rounds go on while they link this share of the pairs they test.
FRUITFUL = 0.1
#: Counters of regions, by hash; sizes of texts that meet in prefixes are told apart by this ratio.
COUNTERS = 1 << 22
STEP = 1.1
#: 64-bit words of the sketch by which sets that differ in too many elements are told apart before they meet.
SKETCH = 8
#: Darts to throw so that each coordinate gets one, but for about exp(-2) of the texts' misses.
DARTS = COORDS * (log(COORDS) + 2)
#: Nodes (16 bytes of hash, a key and a number) that a broadcast may hold.
MAX_BROADCAST_NODES = 500_000
SECOND = np.uint64(0x2545F4914F6CDD1D)
POISSON = np.cumsum([exp(-1) / factorial(k) for k in range(18)])


def regions(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash) of each unit region, and each text's two hashes of all its words (0: none).

    A region is a shingle and how often it occurred before in the text, so the
    weighted Jaccard similarity is that of the sets of regions.
    """
    cp, begins = code_points([t.lower() for t in texts])
    at, end = spans(alnum_table()[cp])
    words = span_hashes(cp, at, end)
    owner = (np.searchsorted(begins, at, side="right") - 1).astype(np.int64)
    n = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)])
    whole = np.zeros((len(texts), 2), np.uint64)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), whole
    place = np.arange(len(words)) - first[owner]
    has = n > 0
    keyed = mix(words + mix(place.astype(np.uint64) * BASE))
    for k, h in enumerate((keyed, mix(keyed ^ SECOND))):
        whole[has, k] = mix(np.add.reduceat(h, first[:-1][has]) ^ n[has].astype(np.uint64)) | np.uint64(1)
    size = np.minimum(SHINGLE, n[owner])
    is_start = place <= n[owner] - size
    starts = np.flatnonzero(is_start)
    h = np.zeros(len(starts), np.uint64)
    for k in range(SHINGLE):
        here = np.minimum(starts + k, len(words) - 1)
        h = np.where(k < size[starts], h * BASE + words[here], h)
    h, whose = mix(h), owner[starts]
    order = np.argsort(h ^ mix(whose.astype(np.uint64)), kind="stable")
    h, whose = h[order], whose[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (whose[1:] == whose[:-1])
    run = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    nth = (np.arange(len(h)) - run).astype(np.uint64)
    return whose, mix(h + nth * np.uint64(0xC2B2AE3D27D4EB4F)), whole


def signatures(whose: np.ndarray, region: np.ndarray, n_texts: int) -> np.ndarray:
    """n_texts x COORDS dart ids; 0 where a text has no region."""
    out = np.zeros((n_texts, COORDS), np.uint64)
    n = np.bincount(whose, minlength=n_texts)
    bound = DARTS / np.maximum(n, 1)
    todo = n > 0
    while todo.any():
        use = todo[whose]
        own, cell = whose[use], region[use]
        units = np.ceil(bound[own]).astype(np.int64)
        own, cell = np.repeat(own, units), np.repeat(cell, units)
        unit = np.arange(len(own)) - np.repeat(np.cumsum(units) - units, units)
        cell = mix(cell + unit.astype(np.uint64) * BASE)
        darts = np.searchsorted(POISSON, (cell >> np.uint64(11)) * 2.0**-53, side="right")
        own, cell, unit = np.repeat(own, darts), np.repeat(cell, darts), np.repeat(unit, darts)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(darts) - darts, darts)
        h = mix(cell + (nth + 1).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        rank = unit + (h >> np.uint64(11)) * 2.0**-53
        hit = rank < bound[own]
        own, h, rank = own[hit], h[hit], rank[hit]
        dart = mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        coord = own * COORDS + ((dart >> np.uint64(20)) % np.uint64(COORDS)).astype(np.int64)
        earliest = np.full(n_texts * COORDS, np.inf)
        np.minimum.at(earliest, coord, rank)
        won = rank == earliest[coord]
        flat = np.zeros(n_texts * COORDS, np.uint64)
        flat[coord[won]] = dart[won]
        got = flat.reshape(n_texts, COORDS)
        done = todo & (got != 0).all(axis=1)
        out[done] = got[done]
        todo &= ~done
        bound = bound * 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """n_texts x BANDS bucket keys; the band's number is part of the key."""
    rows = COORDS // BANDS
    h = np.zeros((len(signature), BANDS), np.uint64)
    parts = signature.reshape(len(signature), BANDS, rows)
    for k in range(rows):
        h = h * BASE + parts[:, :, k]
    return mix(h + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)).view(np.int64)


def scanned(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, ``keep``, whole (128 bits of hash of all words) and the buckets of each text with words."""

    def scan(cols, texts):
        whose, region, whole = regions(texts)
        has = np.flatnonzero(whole[:, 0])
        keys = band_keys(signatures(whose, region, len(texts))[has])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
        return {**{c: [v[i] for i in has] for c, v in cols.items()}, "whole": [whole[i].tobytes() for i in has], "buckets": lists}

    kinds = dict(docs.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep))
    return map_texts(docs.where(F.col(key).isNotNull()), scan, f"{head}, whole binary, buckets array<long>", [key, *keep], text)


def cell_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """node, cells (its distinct regions by 32 bits of hash) of ``wanted`` (node, key, whole)."""

    def cells(cols, texts):
        whose, region, whole = regions(texts)
        own = np.array([w.tobytes() == x for w, x in zip(whole, cols["whole"], strict=True)], bool)
        both = np.unique((whose.astype(np.uint64) << np.uint64(32)) | (region >> np.uint64(32)))
        both = both[own[(both >> np.uint64(32)).astype(np.int64)]]
        n = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(texts))[own]
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return {"node": [x for x, o in zip(cols["node"], own, strict=True) if o], "cells": pa.ListArray.from_arrays(pa.array(ends), pa.array(both.astype(np.uint32).view(np.int32)))}

    rows = docs.select(key, text).join(sized(wanted, MAX_BROADCAST_NODES), key)
    found = checkpointed(map_texts(rows, cells, "node long, cells array<int>", ["node", "whole"], text), "cells")
    if found.count() == wanted.count():
        return found
    # repeated rows: any of them will do
    once = checkpointed(found.dropDuplicates(["node"]), "cells")
    drop(found)
    return once


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (a, b) of ``pairs`` whose similarity is at least SIMILAR."""
    ends = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    known = sets.join(sized(ends), "node", "left_semi")
    one = pairs.join(known.select(F.col("node").alias("b"), F.col("cells").alias("cells_b")), "b")
    both = one.join(known.select(F.col("node").alias("a"), F.col("cells").alias("cells_a")), "a")
    shared = F.size(F.array_intersect("cells_a", "cells_b"))
    total = F.size("cells_a") + F.size("cells_b") - shared
    out = checkpointed(both.where(shared >= SIMILAR * total).select("a", "b"), "links")
    drop(ends)
    return out


def bits(pairs: list[tuple[str, str]]) -> Column:
    """How many bits the words of each pair of columns both have, over all pairs."""
    return reduce(Column.__add__, [F.bit_count(F.col(a).bitwiseAND(F.col(b))) for a, b in pairs])


def least_shared(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray:
    """How many elements sets of ``n`` and ``m`` share at least if they are similar."""
    return np.ceil(SIMILAR / (1 + SIMILAR) * (n + m) - 1e-9).astype(np.int64)


def most_apart(n: str, m: str) -> Column:
    """How many elements that one of them alone has similar sets of ``n`` and ``m`` have at most."""
    both = F.col(n) + F.col(m)
    return both - 2 * F.ceil(F.lit(SIMILAR / (1 + SIMILAR)) * both - F.lit(1e-9))


def size_class(n: np.ndarray | int) -> np.ndarray:
    return (np.log(n) / np.log(STEP)).astype(np.int64)


def prefix_rows(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, place, side) of one set: the cells by which a similar set of each size class meets it.

    Two sets that share k of their elements share one among the first n - k + 1 of
    both, in any order; here the rarest come first. Side 0 (the smaller size class)
    meets side 1, and sets of one size class (2) meet each other. Cells of one
    component alone (no ``counts``) come before all others and are left out.
    """
    n = len(cells)
    rarity = counts[cells.view(np.uint32) % COUNTERS]
    order = np.lexsort((mix(cells.view(np.uint32).astype(np.uint64)), rarity))
    h, rarity = mix(cells.view(np.uint32)[order].astype(np.uint64)), rarity[order]
    low, high = int(np.ceil(SIMILAR * n - 1e-9)), int(n / SIMILAR + 1e-9)
    own = int(size_class(n))
    out = []
    for other in range(int(size_class(low)), int(size_class(high)) + 1):
        length = n - int(least_shared(n, max(low, int(STEP**other - 1e-6)))) + 1
        place = np.flatnonzero(rarity[: max(0, length)])
        bucket = mix(h[place] + np.uint64((min(own, other) * 65_537 + max(own, other) + 1) * int(BASE) & (1 << 64) - 1))
        out.append((bucket, place, np.full(len(place), 2 if other == own else int(other < own))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def sketched(sets: DataFrame) -> DataFrame:
    """node, s0 ... of ``sets``: the parities of its cells, dealt to the bits by hash.

    Sketches differ in the parities of the cells that one set alone has, so in as many
    bits at most as there are such cells.
    """
    size = 64 * SKETCH

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                node, cells = batch.slice(i, 64).columns
                each = np.repeat(np.arange(len(node)), np.diff(cells.offsets.to_numpy()))
                bit = mix(cells.flatten().to_numpy().view(np.uint32).astype(np.uint64)) % np.uint64(size)
                odd = np.bincount(each * size + bit.astype(np.int64), minlength=len(node) * size) & 1
                words = np.packbits(odd.astype(np.uint8).reshape(len(node), size), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([node, *[pa.array(w) for w in words.T]], names=["node", *names])

    names = [f"s{k}" for k in range(SKETCH)]
    return sets.select("node", "cells").mapInArrow(run, ", ".join(f"{c} long" for c in ("node", *names)))


def crossing(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b) of different labels that may be similar: no similar pair is left out.

    Sets of one bucket, label and size first meet as a group, if sizes and places allow
    a pair of theirs to be similar and those bits of the sketch on which each group
    agrees don't rule it out. The sets of the smaller group are then named, and those
    of the larger one only as far as the two sketches allow, so that neither many
    labels nor a large one make a row for each pair of a bucket.
    """
    known = sets.join(labels, "node").select("node", "label", "cells")

    def count(batches):
        for batch in batches:
            cells = batch.column(2)
            each = np.repeat(batch.column(1).to_numpy(), np.diff(cells.offsets.to_numpy()))
            slots = cells.flatten().to_numpy().view(np.uint32) % COUNTERS
            order = np.argsort(slots, kind="stable")
            slot, head, n = np.unique(slots[order], return_index=True, return_counts=True)
            if len(slot):
                low, high = (f.reduceat(each[order], head) for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n), pa.array(low), pa.array(high)], names=["slot", "n", "low", "high"])

    # a table of fixed size, whatever the input; slots of one label's cells alone join nothing, and count as 0
    found = known.mapInArrow(count, "slot int, n long, low long, high long").groupBy("slot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = found.where("low != high").select("slot", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int32)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    sent = sets.sparkSession.sparkContext.broadcast(counts)

    def rows(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                made = [prefix_rows(x.values.to_numpy(), sent.value) for x in part.column(2)]
                each = np.repeat(np.arange(part.num_rows), [len(x[0]) for x in made])
                bucket, place, side = (np.concatenate(x) for x in zip(*made, strict=True))
                n = np.array([len(x.values) for x in part.column(2)])[each]
                # the largest set that a set can be similar to if this cell is the first that they share
                reach = np.floor((n - place) * (1 + SIMILAR) / SIMILAR + 1e-6) - n
                own = [c.take(pa.array(each)) for c in part.columns[:2]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(bucket.view(np.int64)), *[pa.array(x.astype(np.int32)) for x in (n, reach, side)]], names=["node", "label", "bucket", "n", "reach", "side"])

    met = checkpointed(known.mapInArrow(rows, "node long, label long, bucket long, n int, reach int, side int"), "prefixes")
    ranges = [f(c).alias(f"{at}_{c}") for c in ("label", "side", "n", "reach") for at, f in (("least", F.min), ("most", F.max))]
    open_ = met.groupBy("bucket").agg(*ranges).where("least_label != most_label and (most_side = 2 or least_side != most_side)")
    open_ = checkpointed(open_.select("bucket", "least_n", "most_reach"), "buckets")
    left = met.join(sized(open_, MAX_BROADCAST_NODES), "bucket").where("reach >= least_n and n <= most_reach").select(met.columns)
    left = checkpointed(left.join(sketched(known), "node"), "members")

    words = range(SKETCH)
    alike = [f for k in words for f in (F.bit_and(f"s{k}").alias(f"ones{k}"), F.bit_and(F.bitwise_not(f"s{k}")).alias(f"zeros{k}"))]
    groups = checkpointed(left.groupBy("bucket", "label", "n", "side").agg(F.max("reach").alias("reach"), F.count("*").alias("size"), *alike), "groups")
    ends = [groups.where(F.col("side").isin(s, 2)).select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in groups.columns[1:]]) for s in (0, 1)]
    differ = F.when(F.col("side_0") == 2, F.col("label_0") < F.col("label_1")).otherwise(F.col("label_0") != F.col("label_1"))
    apart = bits([(f"{x}{k}_0", f"{y}{k}_1") for k in words for x, y in (("ones", "zeros"), ("zeros", "ones"))])
    meetings = ends[0].join(ends[1], "bucket").where(differ & (F.col("n_0") <= F.col("reach_1")) & (F.col("n_1") <= F.col("reach_0")) & (apart <= most_apart("n_0", "n_1")))
    few = F.col("size_0") <= F.col("size_1")
    meetings = checkpointed(meetings.select("bucket", *[F.when(few, F.col(f"{c}_{s}")).otherwise(F.col(f"{c}_{1 - s}")).alias(f"{c}_{s}") for s in (0, 1) for c in ("label", "n")]), "meetings")

    sides = [left.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in left.columns if c not in ("bucket", "side")]) for s in (0, 1)]
    one = meetings.join(sides[0], ["bucket", "label_0", "n_0"]).where("n_1 <= reach_0")
    both = one.join(sides[1], ["bucket", "label_1", "n_1"]).where("n_0 <= reach_1")
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"s{k}_0").bitwiseXOR(F.col(f"s{k}_1"))) for k in words])
    both = both.where(apart <= most_apart("n_0", "n_1"))
    out = checkpointed(both.select(F.least("node_0", "node_1").alias("a"), F.greatest("node_0", "node_1").alias("b")).distinct(), "pairs")
    drop(met, open_, left, groups, meetings)
    return out


def contracted(links: DataFrame) -> DataFrame:
    """(node, label) of all ends of ``links`` (u, v): one label for each component.

    Every node hooks to its least neighbour, chains are halved until each node knows
    its root, and the links between roots are what is left: at most half of the nodes,
    so the tables shrink from turn to turn.
    """
    found = None
    links = checkpointed(links.where("u != v").distinct(), "links")
    while links.limit(1).count():
        both = links.union(links.select("v", "u"))
        hooked = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("label")), "labels")
        while True:
            on = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
            step = checkpointed(hooked.join(on, "label").select("node", F.col("label").alias("old"), F.col("root").alias("label")), "labels")
            moved = step.where("old != label").limit(1).count()
            drop(hooked)
            hooked = step
            if not moved:
                break
        hooked = hooked.select("node", "label")
        ends = links
        for end in ("u", "v"):
            ends = ends.join(hooked.select(F.col("node").alias(end), F.col("label").alias(f"{end}2")), end)
        rest = checkpointed(ends.select(F.col("u2").alias("u"), F.col("v2").alias("v")).where("u != v").distinct(), "links")
        drop(links)
        links = rest
        found = hooked if found is None else checkpointed(relabelled(found, hooked), "labels")
    return links.selectExpr("u as node", "v as label") if found is None else found


def relabelled(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """``labels`` (node, label) with each label's own label in ``roots``, where it has one."""
    return labels.join(roots.toDF("label", "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` with the components that ``links`` (a, b) connect made one."""
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end)
    out = checkpointed(relabelled(labels, contracted(links.select(F.col("label_a").alias("u"), F.col("label_b").alias("v")))), "labels")
    drop(labels)
    return out


def partners(entry: DataFrame, tested: DataFrame | None, turn: int) -> DataFrame:
    """(a, b): each node with one leader of its buckets that is of another component, one pair per node at most.

    First the node with the most companions leads a bucket, in later turns another one.
    """
    order = F.struct("degree", "node") if turn == 0 else F.struct(F.xxhash64("node", "bucket", F.lit(turn)).alias("degree"), F.col("node"))
    leaders = entry.groupBy("bucket").agg(F.max(order).alias("lead"), F.max_by("label", order).alias("lead_label"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    leaders = checkpointed(leaders.where("lo != hi").select("bucket", "lead", "lead_label"), "leaders")
    met = entry.join(leaders, "bucket").where("label != lead_label").select("node", "lead")
    if tested is not None:
        ends = met.select("node", "lead", F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
        met = ends.join(tested, ["a", "b"], "left_anti")
    best = met.groupBy("node").agg(F.max("lead").alias("lead"))
    out = checkpointed(best.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct(), "pairs")
    drop(leaders)
    return out


def classified(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, ``keep``, whole, class_id (the least key) and first (the least text of that key) of rows with words."""
    scan = checkpointed(scanned(docs, key, text, keep), "signatures")
    # a node for each distinct text; texts that are equal have equal buckets
    nodes = scan.groupBy("whole").agg(F.min(key).alias(key), F.first("buckets").alias("buckets"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    entries = nodes.select("node", F.explode("buckets").alias("bucket"))
    sizes = checkpointed(entries.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1), "sizes")
    shared = checkpointed(entries.join(sizes, "bucket"), "shared")
    degree = checkpointed(shared.groupBy("node").agg(F.sum("size").alias("degree")), "degrees")
    ranked = checkpointed(shared.join(degree, "node").select("bucket", "node", "degree"), "ranked")
    drop(sizes, shared)

    labels = checkpointed(degree.select("node", F.col("node").alias("label")), "labels")
    sets = cell_sets(docs, nodes.join(degree, "node", "left_semi").select("node", key, "whole"), key, text)
    tested, turn = None, 0
    while True:
        entry = checkpointed(ranked.join(labels, "node"), "entries")
        pairs = partners(entry, tested, turn)
        drop(entry)
        n_pairs = pairs.count()
        found = compared(pairs, sets) if n_pairs else pairs
        n_found = found.count()
        if n_found:
            labels = merged(labels, found)
        if not n_pairs or n_found <= FRUITFUL * n_pairs:
            break
        tested = pairs if tested is None else tested.union(pairs)
        turn += 1
    # the rest at once: all that buckets of several components hold
    entry = checkpointed(ranked.join(labels, "node"), "entries")
    split = entry.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
    left = checkpointed(entry.join(split, "bucket", "left_semi").select("node", "label").distinct(), "left")
    if left.limit(1).count():
        found = compared(crossing(sets, left), sets)
        if found.limit(1).count():
            labels = merged(labels, found)
    drop(entry, left, sets, ranked)
    named = nodes.select("node", key, "whole").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = checkpointed(named, "named")
    least = named.groupBy("label").agg(F.min(F.struct(key, "whole")).alias("least"))
    named = checkpointed(named.join(least, "label").select("whole", F.col(f"least.{key}").alias("class_id"), F.col("least.whole").alias("first")), "classes")
    return scan.drop("buckets").join(named, "whole")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id (least key of the class) of every row."""
    rest = without_words(docs, key, text).select(key, F.col(key).alias("class_id"))
    return classified(docs, key, text).select(key, "class_id").union(rest)


def without_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows that form no group: a null key, or no letter or digit in the text."""
    kind = dict(docs.dtypes)[key]

    def bare(cols, texts):
        ids = [i for i, t in zip(cols[key], texts, strict=True) if i is None or not any(map(str.isalnum, t))]
        return {key: ids}

    return map_texts(docs, bare, f"`{key}` {kind}", [key], text)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: one of the class's least key and, where that has several texts, the least of those.

    Rows are told apart by key and text, so different texts of one key stand for themselves.
    """
    named = docs.withColumns(dict(zip(ROW, row_hash(key, text), strict=True)))
    found = checkpointed(classified(named, key, text, ROW), "classes")
    first = (F.col(key) == F.col("class_id")) & (F.col("whole") == F.col("first"))
    kept = without_rows(docs, found.where(~first), key, text)
    # of rows that agree in key and words, one of the least form
    again = found.where(first).groupBy("first").agg(F.count("*").alias("n"), F.min(F.struct(*ROW)).alias("row")).where("n > 1")
    again = checkpointed(again, "repeated")
    if not again.limit(1).count():
        return kept
    twice = found.where(first).join(sized(again.select("first")), "first", "left_semi").select(*ROW)
    tagged = kept.withColumns(dict(zip(ROW, row_hash(key, text), strict=True)))
    one = tagged.join(sized(again.select("row.*")), list(ROW), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = one.groupBy(*ROW).agg(F.min_by(whole, F.to_json(whole)).alias("r")).select("r.*")
    return without_rows(kept, twice, key, text).unionByName(one)


def op3(docs: DataFrame) -> DataFrame:
    out = classes(docs)
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
