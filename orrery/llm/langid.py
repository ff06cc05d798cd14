"""Language ID: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, hash buckets by languages, fitted on
a hash sample of labelled rows (``fit_rows``, in expectation, and of each language
its ``LEAST_ROWS`` rows of the least hashes at least, so that none is lost) and sent to
the executors as a broadcast of bounded size (``MAX_MODEL_BYTES``: beyond a thousand
languages there are fewer buckets). Texts are
scored in sparse batches: hashed n-grams pick matrix rows, which are summed per
document. Training is a sum of counts, so any order of rows gives the same model.

Edge cases: null text and text without a letter give ``und`` and score 0; rows
repeat in the output as often as in the input; an empty table gives no rows; with
no labelled rows every language is ``und``. Columns other than those named are
not read, so extra columns cannot clash. Equal likelihoods go to the language
that sorts first. Case is folded; everything but letters counts as one space.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import code_points, filter_texts, letter_table, map_texts, mix

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
FIT_ROWS = 20_000
LEAST_ROWS = 100
MAX_MODEL_BYTES = 256 << 20


def grams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram; each text's number of letters."""
    low = [t.lower() for t in texts]
    cp, begins = code_points(low)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(begins))
    cp = np.where(letter_table()[cp], cp, np.uint32(32))
    # each text by itself: words, with one space behind each
    keep = cp != 32
    keep[1:] |= (cp[:-1] != 32) & (owner[1:] == owner[:-1])
    cp, owner = cp[keep].astype(np.uint64), owner[keep]
    letters = np.bincount(owner[cp != 32], minlength=len(texts))
    found, whose = [], []
    for n in ORDERS:
        m = len(cp) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(1_000_003) + cp[k : k + m]
        ok = owner[:m] == owner[n - 1 :]
        if n == 1:
            ok = cp != 32
        found.append((mix(h[ok]) & np.uint64(buckets - 1)).astype(np.int64))
        whose.append(owner[:m][ok])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), letters
    return np.concatenate(found), np.concatenate(whose), letters


def buckets_for(languages: int) -> int:
    """BUCKETS, or the greatest power of two with which the model keeps to MAX_MODEL_BYTES."""
    buckets = BUCKETS
    while buckets > 1 and languages * buckets * 4 > MAX_MODEL_BYTES:
        buckets //= 2
    return buckets


def fit(rows: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, matrix of buckets x languages) from rows with text and label."""
    rows = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(key, label, text)
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("string")).count().collect()}
    langs = sorted(sizes)
    buckets = buckets_for(len(langs))
    share = min(1.0, fit_rows / max(1, sum(sizes.values())))
    if share < 1:
        rows = sampled(rows, sizes, share, label, key)
    rows = rows.repartition(8)

    def count(cols, texts):
        bucket, owner, _ = grams(texts, buckets)
        langs, code = np.unique(np.array(cols[label], dtype=object).astype(str), return_inverse=True)
        pair, n = np.unique(code[owner].astype(np.int64) * buckets + bucket, return_counts=True)
        return {"lang": langs[pair // buckets].tolist(), "bucket": pair % buckets, "n": n}

    counts = map_texts(rows, count, "lang string, bucket long, n long", [label], text)
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    table = np.full((buckets, len(langs)), 0.5)
    at = {x: i for i, x in enumerate(langs)}
    if len(got):
        np.add.at(table, (got["bucket"].to_numpy(np.int64), got["lang"].map(at).to_numpy(np.int64)), got["n"].to_numpy(float))
    return langs, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32)


def sampled(rows: DataFrame, sizes: dict[str, int], share: float, label: str, key: str) -> DataFrame:
    """``share`` of the rows by a hash of the key, and LEAST_ROWS at least of each language that has so many.

    A row is kept if its hash is under its language's bound. Of a language for which
    ``share`` makes fewer than LEAST_ROWS, the bound is its LEAST_ROWS-th least hash
    (the hashes are counted once more, in the part of them that is sure to hold it).
    """
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30))
    name = F.col(label).cast("string")
    bounds = {x: int(share * (1 << 30)) for x in sizes}
    rare = [x for x, n in sizes.items() if share * n < LEAST_ROWS]
    todo = {x: min(1.0, 2 * LEAST_ROWS / sizes[x]) for x in rare}
    while todo:
        limit = F.element_at(F.create_map(*[F.lit(y) for x, part in todo.items() for y in (x, int(part * (1 << 30)))]), name)
        found: dict[str, list[int]] = {}
        for r in rows.where(name.isin(*todo) & (draw < limit)).select(name.alias("lang"), draw.alias("draw")).distinct().collect():
            found.setdefault(r["lang"], []).append(r["draw"])
        done = [x for x, part in todo.items() if part >= 1 or len(found.get(x, [])) >= LEAST_ROWS]
        for x in done:
            bounds[x] = max(bounds[x], sorted(found[x])[:LEAST_ROWS][-1] + 1)
        todo = {x: min(1.0, 2 * part) for x, part in todo.items() if x not in done}
    return rows.where(draw < F.element_at(F.create_map(*[F.lit(y) for x, n in bounds.items() for y in (x, n)]), name))


def posteriors(names: list[str], table: np.ndarray, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    bucket, owner, letters = grams(texts, len(table))
    n = np.bincount(owner, minlength=len(texts))
    pred, sure = ["und"] * len(texts), np.zeros(len(texts))
    if len(bucket) and names:
        total = np.stack([np.bincount(owner, table[bucket, j], len(texts)) for j in range(len(names))], axis=1)
        total = total / np.sqrt(np.maximum(n, 1))[:, None]
        best = total.argmax(axis=1)
        p = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
        for i in np.flatnonzero(letters):
            pred[i], sure[i] = names[best[i]], float(p[i])
    return pred, sure


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (the posterior, with evidence tempered to the square root of the n-grams)."""
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def score(cols, texts):
        pred, sure = posteriors(*model.value, texts)
        return {key: cols[key], "lang_pred": pred, "score": sure}

    return map_texts(docs, score, f"`{key}` {dict(docs.dtypes)[key]}, lang_pred string, score double", [key], text)


def identified(docs: DataFrame, langs: list[str], matrix: np.ndarray, least: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` whose language is known with a score of ``least`` or more."""
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def known(texts):
        pred, sure = posteriors(*model.value, texts)
        return (sure >= least) & (np.array(pred, dtype=object) != "und")

    return filter_texts(docs, known, text)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows whose crc32 of doc_id leaves no remainder of 1 by 3."""
    return docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(True)))


def op1(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    out = predict(docs, *fit(training_rows(docs)))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
