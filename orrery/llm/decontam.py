"""Benchmark decontamination by the q-gram lemma.

A text within k edits of a passage of m characters shares m - q + 1 - k q of its
q-grams at least, all on diagonals (text place less passage place) that differ by
k at most. So the shared q-grams are counted in diagonal bands of width 2 w that
overlap by half, w >= k: one band holds all of them. Bands that meet the bound are
verified by a banded alignment of the passage within the text; a passage counts as
found up to ``BUDGET`` edits per character. A passage is indexed by the longest of
the ``QS`` for which its bound is above zero, so the filter leaves none out.

Both sides are case-folded, with everything but letters and digits as one space.
The passages are a stated query set: they are taken in blocks of about
``BLOCK_CHARS`` characters, each a broadcast, and met with all texts in one scan; a
worker holds one block at a time where there are several. Passages that share many
q-grams are counted in ranges of passages, ``ENTRIES`` meetings at a time.

Edge cases: a null or empty text or passage matches nothing; a passage of fewer
than ``SHORT`` characters matches only a text that is equal to it. Repeated rows come
back as often as they came; equal passages each get a row; an empty table gives no
rows. Other columns are not read; where ``key`` and ``item`` bear one name, the item's
column is named ``benchmark_`` and that name. Of several places the one with the fewest
edits, then the first, is reported.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import alnum_table, code_points, filter_texts, grouped, map_texts, mix

QS = (8, 4)
SHORT = 8
BUDGET = 0.1
BLOCK_CHARS = 4 << 20
ENTRIES = 4 << 20
BITS = 23
SLOTS = (1 << 20) - 1


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normal code points of all texts, each behind a space, and where each text begins."""
    cp, begins = code_points([" " + t.lower() for t in texts])
    cp = np.where(alnum_table()[cp], cp, np.uint32(32))
    owner = np.repeat(np.arange(len(texts)), np.diff(begins))
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32) | (owner[1:] != owner[:-1])
    cp, owner = cp[keep], owner[keep]
    return cp, np.searchsorted(owner, np.arange(len(texts) + 1))


def qgrams(cp: np.ndarray, q: int) -> np.ndarray:
    """Hash of the ``q`` characters from each place on; q is a power of two."""
    h = cp.astype(np.uint64) + np.uint64(7)
    size = 1
    while size < q:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15) + (h[size:] ^ np.uint64(0xABCD * size))
        h ^= h >> np.uint64(31)
        size *= 2
    return mix(h)


class Index:
    """The q-grams of some passages, for one q."""

    def __init__(self, q: int, items: list[int], texts: list[np.ndarray], bound: np.ndarray, width: np.ndarray):
        self.q, self.bound, self.width = q, bound, width
        hashes = [qgrams(texts[i], q) for i in items]
        n = np.fromiter(map(len, hashes), np.int64, len(hashes))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hash, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.item = np.repeat(np.array(items, np.int64), n)[order]
        self.place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))[order]
        # places of the postings by (q-gram, passage), to find a range of passages in each
        self.ranked = np.repeat(np.arange(len(self.hash)), np.diff(self.first)) * len(texts) + self.item
        self.texts = len(texts)
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[(self.hash & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True
        self.least = bound[items].min()

    def bands(self, cp: np.ndarray, begins: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, passage, band) of the bands whose shared q-grams meet the bound."""
        if len(cp) < self.q:
            return []
        h = qgrams(cp, self.q)
        at = np.flatnonzero(self.bits[(h & np.uint64((1 << BITS) - 1)).astype(np.int64)])
        row = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        ok = self.hash[row] == h[at]
        at, row = at[ok], row[ok]
        owner = np.searchsorted(begins, at, side="right") - 1
        enough = np.bincount(owner, minlength=len(begins) - 1) >= self.least
        ok = enough[owner] & (at + self.q <= begins[owner + 1])
        at, row, owner = at[ok], row[ok], owner[ok]
        ranges = 1 + int((self.first[row + 1] - self.first[row]).sum()) // ENTRIES
        edges = np.linspace(0, self.texts, min(ranges, self.texts) + 1).astype(np.int64)
        found = []
        for low, high in zip(edges, edges[1:], strict=False):
            first = self.first[row] if ranges == 1 else np.searchsorted(self.ranked, row * self.texts + low)
            n = (self.first[row + 1] if ranges == 1 else np.searchsorted(self.ranked, row * self.texts + high)) - first
            entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(self._counted(np.repeat(owner, n), np.repeat(at - begins[owner], n), entry))
        return [x for x in found if len(x[0])]

    def _counted(self, owner: np.ndarray, at: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bands of shared q-grams, given as text, place in it and posting."""
        item, place = self.item[entry], self.place[entry]
        band = (at - place) // self.width[item]
        # hashed counts first: they are no less than a band's own
        slot = (owner * 0x9E3779B1 + item * 0x85EBCA6B + band * 0xC2B2AE35) & SLOTS
        count = np.bincount(slot, minlength=SLOTS + 1)
        before = (slot - 0xC2B2AE35) & SLOTS
        after = (slot + 0xC2B2AE35) & SLOTS
        ok = count[slot] + np.maximum(count[before], count[after]) >= self.bound[item]
        owner, item, band, place = owner[ok], item[ok], band[ok], place[ok]
        # each q-gram of a passage counts once in the two bands that hold its diagonal
        keys = np.stack([np.tile(owner, 2), np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(place, 2)])
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        if not keys.shape[1]:
            return owner, item, band
        new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))
        keys = keys[:3, new]
        head = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        count = np.diff(np.append(head, keys.shape[1]))
        owner, item, band = keys[:, head]
        good = count >= self.bound[item]
        return owner[good], item[good], band[good]


class Passages:
    """A block of passages with indexes of their q-grams."""

    def __init__(self, ids: list, texts: list[str]):
        cp, begins = normal(texts)
        self.ids, self.text = ids, []
        self.short: dict[bytes, list[int]] = {}
        for i in range(len(ids)):
            own = cp[begins[i] : begins[i + 1]]
            own = own[1 : len(own) - (len(own) > 1 and own[-1] == 32)]
            self.text.append(own)
            if 0 < len(own) < SHORT:
                self.short.setdefault(own.tobytes(), []).append(i)
        length = np.array([len(t) for t in self.text] or [0])
        self.edits = np.floor(BUDGET * length).astype(np.int64)
        self.width = np.maximum(self.edits, 8)
        self.indexes = []
        left = length >= SHORT
        for q in QS:
            bound = length - q + 1 - q * self.edits
            items = np.flatnonzero(left & (bound > 0)).tolist()
            left &= bound <= 0
            if items:
                self.indexes.append(Index(q, items, self.text, bound, self.width))

    def aligned(self, text: np.ndarray, i: int, low: int) -> tuple[int, int] | None:
        """(edits, begin diagonal) of the best alignment on the band from diagonal ``low`` on, if within budget."""
        passage, k = self.text[i], int(self.edits[i])
        low -= k
        wide = 2 * int(self.width[i]) + 2 * k + 1
        far = np.iinfo(np.int32).max // 2
        columns = np.arange(wide)
        padded = np.full(len(passage) + wide, -1, np.int64)
        a, b = max(0, low), min(len(text), low + len(padded))
        if b > a:
            padded[a - low : b - low] = text[a:b]
        begin = low + columns  # free begin: before row 0 nothing is paid at places in the text
        cost = np.where((begin >= 0) & (begin <= len(text)), 0, far).astype(np.int64)
        for r, c in enumerate(passage):
            swap = cost + (padded[r : r + wide] != c)
            drop = np.append(cost[1:], far) + 1
            best = np.minimum(swap, drop)
            cost = np.minimum.accumulate(best - columns) + columns
            if cost.min() > k:
                return None
        return int(cost.min()), low + int(cost.argmin())

    def find(self, texts: list[str]) -> dict[tuple[int, int], tuple[int, int]]:
        """{(text, passage): (edits, place)}, places in the normal text."""
        cp, begins = normal(texts)
        out: dict[tuple[int, int], tuple[int, int]] = {}
        bands = [x for index in self.indexes for x in index.bands(cp, begins)]
        for t, i, band in (x for b in bands for x in zip(*map(np.ndarray.tolist, b), strict=True)):
            text = cp[begins[t] : begins[t + 1]]
            got = self.aligned(text, i, band * int(self.width[i]))
            if got:
                got = (got[0], max(0, got[1] - 1))
                out[t, i] = min(out.get((t, i), got), got)
        if self.short:
            for t in range(len(texts)):
                own = cp[begins[t] + 1 : begins[t + 1]]
                for i in self.short.get(own[: len(own) - (len(own) > 0 and own[-1] == 32)].tobytes(), []):
                    out[t, i] = (0, 0)
        return out


def blocks_of(benchmark: DataFrame, item: str, passage: str, block_chars: int) -> list[Broadcast]:
    """The passages in broadcast blocks of about ``block_chars`` characters; the driver holds one at a time."""
    items = benchmark.select(F.col(item).alias("item"), F.coalesce(F.col(passage), F.lit("")).alias("passage"))
    chars = items.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = 1 + chars // block_chars
    sent = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "passage"), F.lit(blocks)) == b).orderBy("item", "passage").collect()
        sent.append(benchmark.sparkSession.sparkContext.broadcast(Passages([r[0] for r in rows], [r[1] for r in rows])))
    return sent


def found_in(blocks: list[Broadcast], texts: list[str]) -> list[tuple[int, object, int, int]]:
    """(text, item, edits, place) of all passages in ``texts``, block by block."""
    out = []
    for block in blocks:
        model = block.value
        for a, b in grouped(texts):
            found = model.find(texts[a:b])
            out += [(a + t, model.ids[i], *found[t, i]) for t, i in sorted(found)]
        if len(blocks) > 1:  # a worker holds one block at a time; the next texts read it from its disk again
            del model
            block.__dict__.pop("_value", None)
    return sorted(out, key=lambda x: x[0])


#: Groups of texts as large as Arrow batches, where blocks are loaded for each.
BATCH = 1 << 40


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """key, item, edits and place of each passage found in each text."""
    name = f"benchmark_{item}" if item == key else item
    schema = f"`{key}` {dict(docs.dtypes)[key]}, `{name}` {dict(benchmark.dtypes)[item]}, edits int, place long"
    blocks = blocks_of(benchmark, item, passage, block_chars)

    def scan(cols, texts):
        found = found_in(blocks, texts)
        return {key: [cols[key][x[0]] for x in found], name: [x[1] for x in found], "edits": [x[2] for x in found], "place": [x[3] for x in found]}

    return map_texts(docs, scan, schema, [key], text, BATCH)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", passage: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without those that hold a passage."""
    blocks = blocks_of(benchmark, item, passage, block_chars)

    def clean(texts):
        mask = np.ones(len(texts), bool)
        mask[[x[0] for x in found_in(blocks, texts)]] = False
        return mask

    return filter_texts(docs, clean, text, BATCH)


def op2(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark)
