"""Quality rules: robust multivariate outliers per language and source.

Each text becomes a vector of transformed statistics (``FEATURES``). For each
group of (language, source) the minimum-covariance-determinant estimate is sought as
FAST-MCD does it: of ``SAMPLE`` rows drawn by a hash, starts (distances from the medians,
and ``SUBSETS`` small random subsets) take ``EARLY`` concentration steps, and those of the
least determinants go on until they settle. The ``BEST`` two of them then take
concentration steps over all rows of the group, again until the determinant settles;
the least one wins. A step takes the ``CENTRAL`` share of rows that lie nearest and
fits mean and covariance to them, which can only lower the determinant. One
reweighting step follows: mean and covariance of all rows within ``NEAR``. Rows whose
squared Mahalanobis distance exceeds ``CUT`` are rejected.

A group's estimate is drawn to that of all groups together by the weight of
``PRIOR`` rows, so that small groups have one of their own too, and none is
treated in another way.

The texts are read once; the statistics are written to the shared checkpoint
folder. A step over all rows is one pass that adds up rows, sums and products by
group, start and bin of the distance: the bins up to the wanted share are the core.
These sums combine on the map side, so a group with a third of all rows is never
gathered, and no task gets more than the bins of a group. The estimates are one row
per group; they are broadcast up to ``MAX_BROADCAST_GROUPS`` groups and joined by
key beyond.

Edge cases: a null text has no words, fails the base rules and is not kept; null
lang or source form groups of their own. Texts that fail the base rules take no
part in the estimates; a group without others has no estimate, and a null distance.
Repeated rows come back as often as they came; an empty table gives no rows. Extra
columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import ROW, checkpointed, drop, row_hash, without_rows
from orrery.llm.text import alnum_table, code_points, map_texts, not_ascii_space, span_hashes, spans, window_hashes

#: Transformed statistics; each with the variance's square root that is added to its own,
#: so that a statistic that is constant in most texts still has a scale. Each is small
#: enough for the statistic's greatest value to be rejected by itself.
FEATURES = {"log_words": 0.5, "log_word_len": 0.08, "symbols": 0.2, "punct": 0.35, "upper": 0.5, "dup_lines": 0.39, "repeats": 0.049, "stutter": 0.1}
CENTRAL = 0.5
#: Make the covariances of the central half, and of what lies within NEAR, consistent for 8 normal variables.
CONSISTENCY, NEAR_CONSISTENCY = 1.626, 1.041
#: Chi-square with 8 degrees of freedom stays below with probability 0.975, and 0.99999.
NEAR, CUT = 17.535, 37.33
#: Rows of a group (in expectation) in which starts are tried; random subsets of SUBSET rows each.
SAMPLE, SUBSETS, SUBSET = 1_500, 20, 16
EARLY, FEW, BEST = 2, 4, 2
#: A start has settled when a step lowers the logarithm of its determinant by less.
SETTLED = 1e-3
#: Settling takes a few steps; this many end it whatever happens.
MOST_STEPS = 40
PRIOR = 50.0
#: Bins of the squared distance for each doubling.
DOUBLING_BINS = 8
MAX_BROADCAST_GROUPS = 20_000
SYMBOLS = np.array([ord(c) for c in "#*$%&|<>"], np.uint32)


def repeated_words(words: np.ndarray, owner: np.ndarray, n_texts: int, size: int = 8) -> np.ndarray:
    """Per text, the words that lie in a window of ``size`` words found again in it."""
    h = window_hashes(words, size)
    out = np.zeros(n_texts, np.int64)
    if not len(h):
        return out
    inside = owner[: len(h)] == owner[size - 1 :]
    pos = np.flatnonzero(inside)
    key = h[pos] ^ (owner[pos].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = pos[order[twice]]
    cover = np.zeros(len(owner) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + size, -1)
    np.add.at(out, owner[np.cumsum(cover[:-1]) > 0], 1)
    return out


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\v\f")]
    return len(lines) - len(set(lines))


def statistics(cols: dict, texts: list[str]) -> dict:
    cp, begins = code_points(texts)
    word = not_ascii_space(cp)
    at, end = spans(word)
    owner = np.searchsorted(begins, at, side="right") - 1
    per = lambda mask: np.add.reduceat(mask.astype(np.int64), begins[:-1])
    n_words, word_chars = np.bincount(owner, minlength=len(texts)), per(word)
    symbol = np.isin(cp, SYMBOLS)
    n_symbols = per(symbol)
    n_punct = per(word & ~symbol & ~alnum_table()[cp])
    lowered = np.fromiter((sum(map(str.isupper, t)) if not t.isascii() else 0 for t in texts), np.int64, len(texts))
    upper = np.where(lowered > 0, lowered, per((cp >= 65) & (cp <= 90)))
    n_lines = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    dup = np.fromiter(map(duplicate_lines, texts), np.int64, len(texts))
    hashes = span_hashes(cp, at, end)
    again = repeated_words(hashes, owner, len(texts))
    echo = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=len(texts))
    chars, words = np.maximum(word_chars, 1), np.maximum(n_words, 1)
    x = [
        np.log1p(n_words),
        np.log(chars / words),
        np.log1p(100 * n_symbols / chars),
        np.log1p(100 * n_punct / chars),
        np.log1p(100 * upper / chars),
        np.log1p(10 * dup / n_lines),
        again / words,
        echo / words,
    ]
    failed = (n_words < 20) | (100 * again > 30 * n_words)
    # reduceat copies an element for an empty range, but each text holds its newline at least
    return {**cols, "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup, "n_repeat_words": again, "base_failed": failed, **dict(zip(FEATURES, x, strict=True))}


STAT_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " + ", ".join(f"{f} double" for f in FEATURES)


def _distance(center: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance; ``inverse`` is a row-major array."""
    names = list(FEATURES)
    off = [F.col(f) - center[i] for i, f in enumerate(names)]
    p = len(names)
    terms = [(off[i] * off[j] * inverse[i * p + j]) * (1 if i == j else 2) for i in range(p) for j in range(i, p)]
    return sum(terms[1:], terms[0])


def _bin(distance: Column) -> Column:
    return F.greatest(F.least(F.floor(F.log2(F.greatest(distance, F.lit(1e-9))) * DOUBLING_BINS), F.lit(20 * DOUBLING_BINS)), F.lit(-8 * DOUBLING_BINS)).cast("int")


def _with_model(rows: DataFrame, model: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Each row with its group's columns of ``model``."""
    return rows.join(F.broadcast(model) if few else model, "grp", how)


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    """Rows, sums and sums of products of the features: bounded rows per group, whatever its size."""
    names = list(FEATURES)
    sums = [F.sum(f).alias(f"s_{i}") for i, f in enumerate(names)]
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p_{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
    return rows.groupBy("grp", *by).agg(F.count("*").cast("double").alias("n"), *sums, *products)


def _mean_and_covariance(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From a row of n, sums and products."""
    p = len(FEATURES)
    mean = total[1 : 1 + p] / total[0]
    second = np.zeros((p, p))
    second[np.triu_indices(p)] = total[1 + p :] / total[0]
    return mean, second + second.T - np.diag(np.diag(second)) - np.outer(mean, mean)


FLOOR = np.diag(np.array(list(FEATURES.values())) ** 2)
MODEL = "grp string, start int, center array<double>, inverse array<double>, logdet double, settled boolean"
COLUMNS = [c.split()[0] for c in MODEL.split(", ")]


def _fit(mean: np.ndarray, covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, inverse and logarithm of the determinant of the estimate from a core."""
    full = CONSISTENCY * covariance + FLOOR
    return mean, np.linalg.inv(full), float(np.linalg.slogdet(full)[1])


def squared(x: np.ndarray, center: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    off = x - center
    return np.einsum("ij,jk,ik->i", off, inverse, off)


def concentrated(x: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The estimate from the central share of rows by ``distance``."""
    core = x[distance <= np.partition(distance, int(np.ceil(CENTRAL * len(x))) - 1)[int(np.ceil(CENTRAL * len(x))) - 1]]
    return _fit(core.mean(axis=0), np.cov(core.T, bias=True).reshape(x.shape[1], x.shape[1]))


def settled(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, float]) -> tuple[np.ndarray, np.ndarray, float]:
    for _ in range(MOST_STEPS):
        step = concentrated(x, squared(x, *model[:2]))
        if model[2] - step[2] < SETTLED:
            return min(step, model, key=lambda m: m[2])
        model = step
    return model


def searched(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """The best models of a sample's rows, found from many starts."""
    x = x[np.lexsort(x.T)]  # the order of rows doesn't matter
    middle = np.median(x, axis=0)
    low, high = np.quantile(x, [0.25, 0.75], axis=0)
    z = (x - middle) / np.maximum((high - low) / 1.349, list(FEATURES.values()))
    models = [concentrated(x, d) for d in ((z * z).sum(axis=1), np.abs(z).max(axis=1), (np.tanh(z) ** 2).sum(axis=1))]
    draw = np.random.default_rng(len(x))
    for _ in range(SUBSETS):
        some = x[draw.integers(0, len(x), SUBSET)]
        models.append(_fit(some.mean(axis=0), np.cov(some.T, bias=True).reshape(x.shape[1], x.shape[1])))
    for _ in range(EARLY):
        models = [concentrated(x, squared(x, *m[:2])) for m in models]
    best = sorted((settled(x, m) for m in sorted(models, key=lambda m: m[2])[:FEW]), key=lambda m: m[2])
    others = [m for m in best[1:] if np.abs(m[0] - best[0][0]).max() > 1e-6]
    return [best[0], *others[: BEST - 1]]


def _started(usable: DataFrame, sizes: DataFrame, few: bool) -> DataFrame:
    """The models of each group's sample, their determinants yet to be found over all rows."""
    # a draw by row: copies of a text, which agree in all features, must not be drawn as one
    draw = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)).cast("double")
    rows = _with_model(usable.withColumn("draw", draw), sizes, few).where(F.col("draw") * F.col("n") <= F.lit(float(SAMPLE * (1 << 30))))

    def search(pdf):
        found = searched(pdf[list(FEATURES)].to_numpy(float))
        return type(pdf)([(pdf["grp"].iloc[0], k, m[0].tolist(), m[1].ravel().tolist(), float("inf"), False) for k, m in enumerate(found)], columns=COLUMNS)

    return checkpointed(rows.select("grp", *FEATURES).groupBy("grp").applyInPandas(search, MODEL), "estimates")


def _stepped(usable: DataFrame, model: DataFrame, few: bool) -> DataFrame:
    """``model`` after a concentration step, over all rows, of the starts that have not settled."""

    def fit(pdf):
        out = []
        for start, rows in pdf.sort_values("bin").groupby("start"):
            values = rows[[c for c in rows.columns if c not in ("grp", "start", "bin", "logdet")]].to_numpy(float)
            held = np.cumsum(values[:, 0])
            core = values[: int(np.searchsorted(held, CENTRAL * held[-1])) + 1].sum(axis=0)
            mean, inverse, logdet = _fit(*_mean_and_covariance(core))
            out.append((rows["grp"].iloc[0], start, mean.tolist(), inverse.ravel().tolist(), logdet, bool(rows["logdet"].iloc[0] - logdet < SETTLED)))
        return type(pdf)(out, columns=COLUMNS)

    each = _with_model(usable, model.where("not settled"), few).select("grp", "start", "logdet", *FEATURES, _bin(_distance(F.col("center"), F.col("inverse"))).alias("bin"))
    step = _moments(each, "start", "logdet", "bin").groupBy("grp").applyInPandas(fit, MODEL)
    out = checkpointed(model.where("settled").union(step), "estimates")
    drop(model)
    return out


def estimates(usable: DataFrame) -> DataFrame:
    """grp, center, inverse of each group of ``usable`` (grp and the features)."""
    sizes = checkpointed(usable.groupBy("grp").agg(F.count("*").alias("n")), "groups")
    few = sizes.count() <= MAX_BROADCAST_GROUPS
    model = _started(usable, sizes, few)
    for _ in range(MOST_STEPS):
        model = _stepped(usable, model, few)
        if not model.where("not settled").limit(1).count():
            break
    least = F.struct("logdet", "start")
    least = model.groupBy("grp").agg(F.min_by("center", least).alias("center"), F.min_by("inverse", least).alias("inverse"))
    near = _with_model(usable, least, few).where(_distance(F.col("center"), F.col("inverse")) <= NEAR)
    own = checkpointed(_moments(near), "moments")
    sums = [c for c in own.columns if c != "grp"]
    # one row: all groups' rows together
    every = np.array(own.agg(*[F.sum(c).alias(c) for c in sums]).first(), float)
    empty = F.lit(None).cast("array<double>")
    if not np.isfinite(every[0]):
        return own.select("grp", empty.alias("center"), empty.alias("inverse"))
    middle, spread = _mean_and_covariance(every)

    def drawn(batches):
        for pdf in batches:
            center, inverse = [], []
            for total in pdf[sums].to_numpy(float):
                mean, covariance = _mean_and_covariance(total)
                part = PRIOR / (total[0] + PRIOR)
                off = mean - middle
                mixed = (1 - part) * covariance + part * spread + part * (1 - part) * np.outer(off, off)
                center.append((mean - part * off).tolist())
                inverse.append(np.linalg.inv(NEAR_CONSISTENCY * mixed + FLOOR).ravel().tolist())
            yield pdf[["grp"]].assign(center=center, inverse=inverse)

    return checkpointed(own.mapInPandas(drawn, "grp string, center array<double>, inverse array<double>"), "model")


def judged(docs: DataFrame, key: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, ``keep``, the statistics, ``distance`` (null where there is no estimate), base_failed and kept."""
    kinds = dict(docs.dtypes)
    head = (key, *keep, lang, source)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in head], STAT_SCHEMA])
    rows = checkpointed(map_texts(docs, statistics, schema, list(head), text), "statistics")
    rows = rows.withColumn("grp", F.to_json(F.array(F.col(lang).cast("string"), F.col(source).cast("string"))))
    model = estimates(rows.where(~F.col("base_failed")).select("grp", *FEATURES))
    out = _with_model(rows, model, model.count() <= MAX_BROADCAST_GROUPS, "left").withColumn("distance", _distance(F.col("center"), F.col("inverse")))
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= CUT))
    return out.select(key, *keep, *[c.split()[0] for c in STAT_SCHEMA.split(", ")], "distance", kept.alias("kept"))


def passed(docs: DataFrame, key: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` that are kept; rows are told apart by key, language, source and text."""
    of = (key, lang, source, text)
    named = docs.withColumns(dict(zip(ROW, row_hash(*of), strict=True)))
    verdicts = checkpointed(judged(named, key, lang, source, text, ROW).select(*ROW, "kept"), "verdicts")
    return without_rows(docs, verdicts.where(~F.col("kept")), *of)


def op7(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
