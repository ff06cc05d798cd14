"""Quality classifier by co-training.

Two views of a document: its text (hashed character pairs, how words repeat, layout
of lines, shares of character classes) and its page metadata (source, language and
stated length, as the table gives them; the text is not read for it). A ridge-penalised logistic regression per view is fitted on
labelled rows; over ``ROUNDS`` rounds each names the rows it is surest of, among
all unlabelled ones and in the proportion of the labels, as examples for the other
(rows that tie at the last place come in together). How sure a view may be called is
measured on labelled rows held back (``floors``): metadata that say little name none.
Both are then calibrated (Platt) on the rows held back, and their log odds over the
prior's are added with weights found there too. All documents are scored.

Only labelled rows are sampled (``LABELLED`` in expectation, chosen by a hash of
the key). The texts are read once; each document's features are written to the
shared checkpoint folder. Unlabelled rows are never gathered: the places at which
a view's surest rows begin come from histograms of fixed length, and a fit sums
gradients and Hessians over them. Which rows were named follows from the earlier
rounds' weights and cuts, so no state is kept by row.

Edge cases: a null or empty text is scored by what is left of it; null metadata are
values of their own; several labels of
a key count as their mean, ties and nulls as none; with labels of one kind or
none, every score is that kind's share (0.5 for none). Repeated rows come back as
often as they came; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.quality import SYMBOLS, duplicate_lines, repeated_words
from orrery.llm.shared import checkpointed, sized
from orrery.llm.text import alnum_table, code_points, map_texts, mix, not_ascii_space, span_hashes, spans

PAIRS = 192
TEXT_DENSE = 23
#: Hashed columns of the metadata view: languages, sources, steps of length.
LANGS, SOURCES, LENGTHS = 8, 32, 12
META = 1 + LANGS + SOURCES + LENGTHS + 3
LABELLED = 8_000
ROUNDS = 4
#: Of the unlabelled rows, the share that each view labels for the other in a round.
TAKEN = 0.05
#: Newton steps of a fit at most.
STEPS = 12
#: A view may name rows at ranks where held rows show this share right, and odds of being right so many times the prior's.
SURE, FACTOR = 0.95, 10.0
#: A rank that no row has.
NEVER = 2**31 - 1
#: Tasks that sum up what the tasks over all rows found.
SUMMED_BY = 8


def text_view(texts: list[str]) -> np.ndarray:
    """Feature rows that follow from the texts alone."""
    n = len(texts)
    cp, begins = code_points(texts)
    owner = np.repeat(np.arange(n), np.diff(begins))
    word = not_ascii_space(cp)
    at, end = spans(word)
    word_owner = owner[at] if len(at) else np.zeros(0, np.int64)
    per = lambda mask: np.bincount(owner[mask], minlength=n)
    n_words, chars = np.bincount(word_owner, minlength=n), np.maximum(per(word), 1)
    words = np.maximum(n_words, 1)

    hashes = span_hashes(cp, at, end)
    again = repeated_words(hashes, word_owner, n)
    echo = np.bincount(word_owner[1:][(hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1])], minlength=n)
    _, first = np.unique(hashes ^ mix(word_owner.astype(np.uint64) + np.uint64(1)), return_index=True)
    distinct = np.bincount(word_owner[first], minlength=n)
    low = np.where((cp >= 65) & (cp <= 90), cp + np.uint32(32), cp)
    pair = (mix(low[:-1].astype(np.uint64) * np.uint64(0x110000) + low[1:]) % np.uint64(PAIRS)).astype(np.int64) if len(low) > 1 else np.zeros(0, np.int64)
    inside = owner[:-1] == owner[1:]
    counts = np.bincount(owner[:-1][inside] * PAIRS + pair[inside], minlength=n * PAIRS).reshape(n, PAIRS)
    share = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    symbol = np.isin(cp, SYMBOLS)
    alnum = alnum_table()[cp]
    n_lines = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, n)
    dup = np.fromiter(map(duplicate_lines, texts), np.int64, n)
    kinds = [per(symbol), per((cp == 33) | (cp == 63)), per((cp >= 65) & (cp <= 90)), per((cp >= 48) & (cp <= 57)), per(word & ~alnum & ~symbol), per(~word)]
    kinds = [x for k in kinds for x in (np.sqrt(k / chars), k > 0.05 * chars)]
    lines = [np.log1p(n_lines), dup / n_lines, np.log1p(chars / n_lines), dup > 0.3 * n_lines, chars <= 1]
    return np.column_stack([
        share, again / words, np.sqrt(echo / words), np.log1p(distinct) / np.log1p(words + 1.0), np.log1p(n_words), np.log(chars / words), n_words == 0, *kinds, *lines,
    ])


def metadata_view(langs: list, sources: list, lengths: list) -> np.ndarray:
    """Feature rows that follow from a page's metadata alone."""
    out = np.zeros((len(langs), META))
    slot = lambda value, n: crc32(str(value).encode()) % n
    for i, (lang, source, length) in enumerate(zip(langs, sources, lengths, strict=True)):
        size = float(np.log1p(max(0, length or 0)))
        out[i, 0] = size
        for k, (value, at, n) in enumerate(((lang, 1, LANGS), (source, 1 + LANGS, SOURCES))):
            if value is None:
                out[i, META - 3 + k] = 1
            else:
                out[i, at + slot(value, n)] = 1
        if length is None:
            out[i, META - 1] = 1
        else:
            out[i, 1 + LANGS + SOURCES + min(LENGTHS - 1, int(size))] = 1
    return out


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the logistic loss, without a penalty, end to end."""
    x = np.column_stack([x, np.ones(len(x))])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.concatenate([x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])


def stepped(w: np.ndarray, found: np.ndarray, ridge: float) -> tuple[np.ndarray, bool]:
    """Weights after a Newton step from ``sums``, and whether they have settled."""
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    gradient, hessian = found[: len(w)], found[len(w) :].reshape(len(w), len(w))
    move = np.linalg.solve(hessian + np.diag(penalty), gradient + penalty * w)
    return w - move * min(1.0, 5 / max(np.abs(move).max(), 1e-12)), bool(np.abs(move).max() < 1e-4)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = STEPS) -> np.ndarray:
    """Weights (the last one constant) by Newton steps."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        w, settled = stepped(w, sums(x, y, w), ridge)
        if settled:
            break
    return w


def ranks(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log odds in steps of a 2,048th of their size, as integers: negative ones for the class 0; 0 for unsure rows."""
    z = (x @ w[:-1] + w[-1]).astype(np.float32)
    return np.where(np.abs(z) >= np.log(SURE / (1 - SURE)), np.sign(z), 0).astype(np.int32) * (np.abs(z).view(np.int32) >> 12)


def labels_given(views: list[np.ndarray], history: list) -> list[np.ndarray]:
    """For each view the labels that the other gave in the rounds so far (NaN: none).

    ``history`` has each round's weights and, by view, the least ranks (class 0, class 1) taken.
    """
    given = [np.full(len(views[0]), np.nan) for _ in views]
    for weights, cuts in history:
        for v in range(2):
            rank, other = ranks(views[v], weights[v]), given[1 - v]
            for label, here in ((0, -rank), (1, rank)):
                other[np.isnan(other) & (here >= cuts[v][label])] = label
    return given


def floors(rank: np.ndarray, y: np.ndarray, prior: float) -> list[int]:
    """By class the least rank from which on held rows (``rank``, ``y``) show that a view may be called sure."""
    out = []
    for label, share in ((0, 1 - prior), (1, prior)):
        here = rank if label else -rank
        order = np.argsort(-here, kind="stable")
        here, wrong = here[order], np.cumsum(y[order] != label)
        errors = (wrong + 1) / (np.arange(len(here)) + 3)
        last = np.append(here[1:] != here[:-1], True)  # ranks that tie stand or fall together
        good = here[(here > 0) & last & (errors <= min(1 - SURE, 1 / (1 + FACTOR * share / (1 - share))))]
        out.append(int(good.min()) if len(good) else NEVER)
    return out


def cut(bins: dict[int, int], n: int) -> int:
    """The rank from which on at least ``n`` rows lie, or all; 1 or more."""
    left = max(1, n)
    for rank in sorted(bins, reverse=True):
        left -= bins[rank]
        if left <= 0:
            return rank
    return 1


def unpacked(x: pa.Array) -> np.ndarray:
    """Feature rows, of both views side by side, from their bytes."""
    return np.frombuffer(b"".join(x.to_pylist()), np.float32).reshape(len(x), -1).astype(float)


def scaled(x: pa.Array, norm: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    return [(v - c) / s for v, (c, s) in zip(np.split(unpacked(x), [len(norm[0][0])], axis=1), norm, strict=True)]


class Pool:
    """The unlabelled rows, as a table of features that is never gathered."""

    def __init__(self, rows: DataFrame, norm: list[tuple[np.ndarray, np.ndarray]]):
        self.rows, self.norm, self.size = rows.select("x"), norm, rows.count()

    def histograms(self, weights: list, history: list) -> list[list[dict[int, int]]]:
        """By view and class: how many rows, of those the other view has no label for, have each rank."""
        norm = self.norm

        def count(batches):
            for batch in batches:
                x = scaled(batch.column(0), norm)
                given = labels_given(x, history)
                for v in range(2):
                    rank, n = np.unique(ranks(x[v], weights[v])[np.isnan(given[1 - v])], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), v, np.int32)), pa.array(rank.astype(np.int32)), pa.array(n.astype(np.int64))], names=["v", "rank", "n"])

        # a float has at most so many ranks: a result of bounded length
        found = self.rows.mapInArrow(count, "v int, rank int, n long").where("rank != 0").groupBy("v", "rank").agg(F.sum("n").alias("n")).toArrow().to_pylist()
        return [[{abs(r["rank"]): r["n"] for r in found if r["v"] == v and (r["rank"] > 0) == bool(label)} for label in (0, 1)] for v in range(2)]

    def sums(self, weights: list, history: list) -> list[np.ndarray]:
        """``sums`` of each view over the rows that the other one has named."""
        sizes = [len(w) * (len(w) + 1) for w in weights]
        norm = self.norm

        def add(batches):
            total = np.zeros(sum(sizes))
            for batch in batches:
                x = scaled(batch.column(0), norm)
                given = labels_given(x, history)
                has = [~np.isnan(g) for g in given]
                total += np.concatenate([sums(x[v][has[v]], given[v][has[v]], weights[v]) for v in range(2)])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        def join(batches):
            total = np.zeros(sum(sizes))
            for batch in batches:
                for x in batch.column(0):
                    total += np.frombuffer(x.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        parts = self.rows.mapInArrow(add, "total binary").repartition(SUMMED_BY).mapInArrow(join, "total binary").toArrow().column(0).to_pylist()
        return np.split(sum((np.frombuffer(p) for p in parts), np.zeros(sum(sizes))), sizes[:1])


def odds(x: np.ndarray, model: tuple) -> np.ndarray:
    center, scale, w, a, b = model
    return a * (((x - center) / scale) @ w[:-1] + w[-1]) + b


def cotrained(labelled: tuple[np.ndarray, ...], y: np.ndarray, held: np.ndarray, unlabelled: DataFrame) -> dict:
    """Models of both views (center, scale, weights, Platt a and b) and the prior's log odds."""
    prior = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    out = {"prior": float(np.log(prior / (1 - prior))), "views": None}
    if not len(y) or not 0 < y.mean() < 1:
        return out
    fit = ~held if 0 < y[~held].mean() < 1 and held.any() and 0 < y[held].mean() < 1 else np.ones(len(y), bool)
    test = held if not fit.all() else fit
    norm = [(v[fit].mean(axis=0), v[fit].std(axis=0) + 1e-3) for v in labelled]
    own = [(v - c) / s for v, (c, s) in zip(labelled, norm, strict=True)]
    weights = [logistic(x[fit], y[fit]) for x in own]
    pool = Pool(unlabelled, norm)
    n_each = int(TAKEN * pool.size)
    history: list[tuple[list, list]] = []
    for _ in range(ROUNDS if n_each else 0):
        bins = pool.histograms(weights, history)
        least = [floors(ranks(own[v][test], weights[v]), y[test], prior) for v in range(2)]
        wanted = (round(n_each * (1 - prior)), round(n_each * prior))
        history.append((weights, [[max(least[v][label], cut(bins[v][label], wanted[label])) for label in range(2)] for v in range(2)]))
        for _ in range(STEPS):
            found = [a + sums(x[fit], y[fit], w) for a, x, w in zip(pool.sums(weights, history), own, weights, strict=True)]
            weights, settled = zip(*[stepped(w, a, 1.0) for w, a in zip(weights, found, strict=True)], strict=True)
            if all(settled):
                break
    models = []
    for v in range(2):
        raw = own[v][test] @ weights[v][:-1] + weights[v][-1]
        a, b = logistic(raw[:, None] / 5, y[test], ridge=0.1)
        models.append((*norm[v], weights[v], max(a, 0.0) / 5, b))
    out["views"] = models
    over = evidence(out, *(v[test] for v in labelled))
    return out | {"weights": np.maximum(logistic(over / 5, y[test], ridge=0.1) * np.array([0.2, 0.2, 1.0]), [0.0, 0.0, -np.inf])}


def evidence(model: dict, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Both views' calibrated log odds, less the prior's."""
    return np.column_stack([odds(x, m) - model["prior"] for x, m in zip((text, meta), model["views"], strict=True)])


def scores(model: dict, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
    if model["views"] is None:
        total = np.full(len(text), model["prior"])
    else:
        total = evidence(model, text, meta) @ model["weights"][:2] + model["weights"][2]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def labelled_keys(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """key, y (1 or 0) of the keys that have a label."""
    named = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg(label).alias("y")).where("y != 0.5")
    return named.select(key, F.when(F.col("y") > 0.5, 1).otherwise(0).alias("y"))


def fitted(known: DataFrame, named: DataFrame, key: str = "doc_id") -> dict:
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30))

    def part(n: int, of: int) -> int:
        return int(min(1.0, n / max(1, of)) * (1 << 30))

    # bounded by the parameter above, in expectation
    wanted = named.where(draw < part(LABELLED, named.count())).toArrow().to_pandas()
    y_of = dict(zip(wanted[key].tolist(), wanted["y"].tolist(), strict=True))
    rows = known.join(F.broadcast(known.sparkSession.createDataFrame(wanted[[key]], schema=f"`{key}` {dict(known.dtypes)[key]}")), key)
    got = rows.select(key, "x").toArrow()
    keys = got.column(key).to_pylist()
    order = np.argsort(np.array(keys), kind="stable") if keys else np.zeros(0, np.int64)
    both = np.split(unpacked(got.column("x"))[order], [PAIRS + TEXT_DENSE], axis=1) if keys else [np.zeros((0, 1))] * 2
    y = np.array([y_of[keys[i]] for i in order], float)
    held = np.array([crc32(str(keys[i]).encode()) % 5 == 0 for i in order], bool)
    return cotrained(tuple(both), y, held, known.where("free"))


def featured(docs: DataFrame, named: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", length: str = "n_chars") -> DataFrame:
    """key, free (no label, and a key), x (features as bytes) of every row."""
    kind = dict(docs.dtypes)[key]
    marked = docs.select(key, text, lang, source, length).join(sized(named.select(key, F.lit(True).alias("__named"))), key, "left")
    marked = marked.withColumn("__free", F.col("__named").isNull() & F.col(key).isNotNull())

    def features(cols, texts):
        x = np.column_stack([text_view(texts), metadata_view(cols[lang], cols[source], cols[length])]).astype(np.float32)
        return {key: cols[key], "free": cols["__free"], "x": [r.tobytes() for r in x]}

    return checkpointed(map_texts(marked, features, f"`{key}` {kind}, free boolean, x binary", [key, lang, source, length, "__free"], text), "features")


def classified(known: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """key, score (probability of good quality), kept (score of 0.5 at least) from rows with features."""
    sent = known.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            s = scores(sent.value, *np.split(unpacked(batch.column(1)), [PAIRS + TEXT_DENSE], axis=1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(s >= 0.5)], names=[key, "score", "kept"])

    return known.select(key, "x").mapInArrow(score, f"`{key}` {dict(known.dtypes)[key]}, score double, kept boolean")


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    named = labelled_keys(labels)
    known = featured(docs, named)
    return classified(known, fitted(known, named))
