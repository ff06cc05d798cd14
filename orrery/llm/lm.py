"""LM scoring: marginal likelihood over all segmentations of a subword lattice.

The pieces are those of an existing vocabulary. Its scores (merge ranks) give the
first weights; one round of expectation over the training words, weighted by how
often each occurs, turns them into unigram probabilities of pieces and of the end
of a text. A word's probability is the sum over all ways to cut it (with its
leading mark) into pieces, by a forward recursion in log space; characters that
are no piece are spelled in byte pieces. No piece reaches over a word's begin, so
a text's probability is the product over its words and its end.

Words are counted once over the whole corpus: each task combines its own words
before the shuffle. The lattice runs once per distinct word, not per occurrence.
The most frequent words (``HEAD_WORDS`` at most, found by a histogram of counts)
are broadcast; all others are joined by word. Since a word beyond the head is
rarer than each in it, no key of that join is hot.

Edge cases: a null text is empty and has its end only; a null key is neither
trained on nor held out. Repeated rows come back as often as they came; an empty
table gives no rows; with no training text, c and N are 0. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, repeat
from math import log, log10

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import checkpointed, drop
from orrery.llm.text import grouped, small_batches

HEAD_WORDS = 200_000
FLUSH_WORDS = 250_000
LEAST = 0.1
MARK = "▁"
LN10 = log(10)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased (both as bytes do it)."""
    return text.encode().lower().split()


class Lattice:
    """Pieces with log probabilities; all segmentations of words at once."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.byte_ids = np.zeros(256, np.int64)
        names, ids, ranks = [], [], np.zeros(model.get_piece_size())
        for i in range(model.get_piece_size()):
            ranks[i] = -model.get_score(i)
            if model.is_byte(i):
                self.byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
                ranks[i] = model.get_piece_size()
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                names.append(model.id_to_piece(i))
                ids.append(i)
        self.size = model.get_piece_size()
        self.longest = max(map(len, names))
        self.set_counts(1 / (ranks + 100), 0)
        keys = np.array([self._hash(np.array([[ord(c) for c in n]], np.uint64))[0] for n in names], np.uint64)
        self.keys, self.ids = np.append(keys, np.uint64(0)), np.append(np.array(ids), 0)
        # two tables of slots; what collides in the first lies in the second
        self.slots = [np.full(1 << 19, len(keys), np.int32) for _ in range(2)]
        for j, key in enumerate(keys.tolist()):
            for table, shift in zip(self.slots, (45, 20), strict=True):
                at = (key >> shift) & ((1 << 19) - 1)
                if table[at] == len(keys):
                    table[at] = j
                    break
            else:
                raise ValueError("two pieces collide in both tables")

    @staticmethod
    def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def _hash(self, cp: np.ndarray) -> np.ndarray:
        h = np.full(cp.shape[:-1], 0xCBF29CE484222325, np.uint64)
        for k in range(cp.shape[-1]):
            h = self._step(h, cp[..., k])
        return h

    def set_counts(self, counts: np.ndarray, ends: float) -> None:
        """Probabilities of pieces and of the end from (expected) counts."""
        total = counts.sum() + ends
        with np.errstate(divide="ignore"):
            self.logp = np.log(counts / total)
        self.log_end = log(ends / total) if ends else 0.0

    def edges(self, cp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per piece length l: (log probability, piece id or -1) from each place on; l = 1 always leads on."""
        n, size = cp.shape
        h = np.full((n, size), 0xCBF29CE484222325, np.uint64)
        out = []
        for k in range(min(size, self.longest)):
            m = size - k
            h = self._step(h[:, :m], cp[:, k : k + m])
            at = self.slots[0][(h >> np.uint64(45)).astype(np.int64)]
            ok = self.keys[at] == h
            other = self.slots[1][((h >> np.uint64(20)) & np.uint64((1 << 19) - 1)).astype(np.int64)]
            at = np.where(ok, at, other)
            piece = np.where(ok | (self.keys[at] == h), self.ids[at], -1)
            p = np.where(piece >= 0, self.logp[piece], -np.inf)
            if k == 0 and (piece < 0).any():
                for c in np.unique(cp[piece < 0]).tolist():
                    p[cp == c] = sum(self.logp[self.byte_ids[b]] for b in chr(c).encode("utf-8", "surrogatepass"))
            out.append((p, piece))
        return out

    @staticmethod
    def _forward(edges: list, n: int, size: int) -> np.ndarray:
        a = np.full((size + 1, n), -np.inf)
        a[0] = 0
        for j in range(1, size + 1):
            terms = np.stack([a[j - k - 1] + edges[k][0][:, j - k - 1] for k in range(min(j, len(edges)))])
            top = terms.max(axis=0)
            a[j] = top + np.log(np.exp(terms - top).sum(axis=0))
        return a

    def by_length(self, words: list[str]):
        """(places in ``words``, code points) for words of equal length, in bounded portions."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, cuts):
            if not len(same):
                continue
            size = int(lengths[same[0]]) + 1
            step = max(1, (1 << 18) // size)
            for part in (same[i : i + step] for i in range(0, len(same), step)):
                text = "".join(MARK + words[i] for i in part)
                yield part, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), size).astype(np.uint64)

    def log_marginals(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability over all segmentations."""
        out = np.zeros(len(words))
        for part, cp in self.by_length(words):
            out[part] = self._forward(self.edges(cp), *cp.shape)[-1]
        return out

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected count of each piece over all segmentations of the weighted words."""
        out = np.zeros(self.size)
        for part, cp in self.by_length(words):
            n, size = cp.shape
            edges = self.edges(cp)
            a = self._forward(edges, n, size)
            b = np.full((size + 1, n), -np.inf)
            b[size] = 0
            for j in range(size - 1, -1, -1):
                terms = np.stack([b[j + k + 1] + edges[k][0][:, j] for k in range(min(size - j, len(edges)))])
                top = terms.max(axis=0)
                b[j] = top + np.log(np.exp(terms - top).sum(axis=0))
            w = weights[part]
            for k, (p, piece) in enumerate(edges):
                m = p.shape[1]
                share = np.exp(a[:m].T + p + b[k + 1 : k + 1 + m].T - a[size][:, None]) * w[:, None]
                hit = piece >= 0
                out += np.bincount(piece[hit], share[hit], self.size)
                if k == 0 and not hit.all():
                    for c, s in zip(cp[~hit].tolist(), share[~hit].tolist(), strict=True):
                        for x in chr(c).encode("utf-8", "surrogatepass"):
                            out[self.byte_ids[x]] += s
        return out


def remainder(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 10


def word_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """word, c (in training texts), others (in all other texts)."""
    rows = docs.select(F.coalesce(remainder(key) != 0, F.lit(False)).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def flushed(counts):
        words = sorted(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], names=["word", "c", "others"])
        for c in counts:
            c.clear()
        return out

    def count(batches):
        counts = (Counter(), Counter())
        for batch in batches:
            train, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in grouped(texts):
                for kind in (True, False):
                    counts[not kind].update(chain.from_iterable(words_of(t) for t, k in zip(texts[a:b], train[a:b], strict=True) if k is kind))
                if len(counts[0]) + len(counts[1]) > FLUSH_WORDS:
                    yield flushed(counts)
        yield flushed(counts)

    return rows.mapInArrow(count, "word string, c long, others long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("others").alias("others"))


def trained(lattice: Lattice, words: DataFrame, ends: int) -> Lattice:
    """The lattice with probabilities from one expectation over the training words."""
    model = words.sparkSession.sparkContext.broadcast(lattice)

    def expect(batches):
        total = np.zeros(model.value.size)
        for batch in batches:
            total += model.value.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["piece", "n"])

    # at most one row per piece of the vocabulary
    got = words.where("c > 0").select("word", "c").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).orderBy("piece").collect()
    counts = np.full(lattice.size, LEAST)
    for piece, n in got:
        counts[piece] += n
    lattice.set_counts(counts, max(ends, LEAST))
    return lattice


def with_marginals(words: DataFrame, lattice: Lattice) -> DataFrame:
    """``words`` with log10 of each word's marginal probability."""
    model = words.sparkSession.sparkContext.broadcast(lattice)

    def score(batches):
        for batch in batches:
            got = model.value.log_marginals(batch.column(0).to_pylist()) / LN10
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=[*batch.schema.names, "lattice"])

    return words.select("word", "c", "others").mapInArrow(score, "word string, c long, others long, lattice double")


def head_bound(words: DataFrame, limit: int) -> int:
    """The least total count at which at most ``limit`` words are as frequent."""
    level = F.floor(F.log2(F.col("c") + F.col("others")) * 8).cast("int")
    held, bound = 0, 1 << 62
    for step, n in sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True):
        if held + n > limit:
            break
        held += n
        bound = step
    return bound


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", lattice: Lattice | None = None, head_words: int = HEAD_WORDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs.sparkSession)
    counted = checkpointed(word_counts(docs, key, text), "counts")
    n_docs = docs.where(remainder(key) != 0).count()
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    train_tokens, kinds = total + n_docs, distinct + (n_docs > 0)
    below = train_tokens + 0.1 * (kinds + 1)
    lattice = trained(lattice or Lattice(), counted, n_docs)
    words = checkpointed(with_marginals(counted, lattice), "words")
    drop(counted)
    bound = head_bound(words, head_words)
    is_head = F.floor(F.log2(F.col("c") + F.col("others")) * 8) >= bound
    head = words.where(is_head).select("word", "c", "lattice").toArrow()
    c = head.column("c").to_numpy().astype(float)
    sent = docs.sparkSession.sparkContext.broadcast((
        head.column("word").combine_chunks(),
        np.append(np.log10((c + 0.1) / below), 0.0),
        np.append(head.column("lattice").to_numpy(), 0.0),
        np.append(c > 0, False),
    ))
    end_base, end_score = log10((n_docs + 0.1) / below), lattice.log_end / LN10
    known_end = int(n_docs > 0)

    def partial(batches):
        names, base, marginal, known = sent.value
        at = {w.encode(): i for i, w in enumerate(names.to_pylist())}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in grouped(texts):
                own = [words_of(t) for t in texts[a:b]]
                n = np.fromiter(map(len, own), np.int64, b - a)
                flat = list(chain.from_iterable(own))
                row = np.fromiter(map(at.get, flat, repeat(-1)), np.int64, len(flat))
                owner = np.repeat(np.arange(b - a), n)
                sums = [np.bincount(owner, x[row], b - a) for x in (base, marginal, known.astype(float))]
                rare: list[list[tuple[bytes, int]]] = [[] for _ in range(b - a)]
                places = np.flatnonzero(row < 0)
                for (t, w), k in Counter(zip(owner[places].tolist(), (flat[i] for i in places), strict=True)).items():
                    rare[t].append((w, k))
                ends = np.concatenate([[0], np.cumsum([len(r) for r in rare])]).astype(np.int32)
                pairs = list(chain.from_iterable(rare))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(col.slice(a, b - a) for col in batch.columns[1:]),
                        pa.array(n + 1),
                        pa.array(sums[2].astype(np.int64) + known_end),
                        pa.array(sums[0] + end_base),
                        pa.array(sums[1] + end_score),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array([w.decode() for w, _ in pairs], pa.string())),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array([k for _, k in pairs], pa.int64())),
                    ],
                    names=[key, "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
                )

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text"), key, F.coalesce(remainder(key) == 0, F.lit(False)).alias("held_out"))
    schema = f"`{key}` {dict(docs.dtypes)[key]}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<string>, times array<long>"
    parts = checkpointed(rows.mapInArrow(partial, schema).withColumn("row", F.monotonically_increasing_id()), "parts")
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(words.where(~is_head).select("word", "c", "lattice"), "word").select(
        "row",
        F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("n_known"),
        (F.log10((F.col("c") + F.lit(0.1)) / F.lit(below)) * F.col("times")).alias("base_score"),
        (F.col("lattice") * F.col("times")).alias("score"),
    )
    names = [key, "held_out", "n_tokens"]
    both = parts.select("row", *names, "n_known", "base_score", "score").unionByName(rare, allowMissingColumns=True)
    out = both.groupBy("row").agg(*[F.max(c).alias(c) for c in names], *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])
    return out.select(*names, "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8(docs: DataFrame) -> DataFrame:
    return scored(docs)
