"""Vectorised text primitives shared by the operators.

Texts of one Arrow batch are laid end to end as code points, each followed by a
newline, so that numpy works on whole groups of documents at a time. Groups hold
about ``GROUP_CHARS`` characters (a longer text is a group of its own), which
bounds the memory of a Python worker by the longest single text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_CHARS = 1 << 18
#: Rows of an Arrow batch, where the session has Spark's default: texts are long.
BATCH_ROWS = 1_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold fewer rows, unless the session has a value of its own, be it Spark's default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Give memory that a task has freed back to the system; Spark keeps its Python workers."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another one
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def grouped(texts: list[str], chars: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Yield (from, to) ranges of ``texts`` of about ``chars`` characters; each text counts as 256 more."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) + 256 > chars:
            yield begin, i
            begin, held = i, 0
        held += len(t) + 256
    if begin < len(texts):
        yield begin, len(texts)


def map_texts(
    df: DataFrame,
    fn: Callable[[dict[str, list], list[str]], dict[str, object]],
    schema: str,
    columns: list[str],
    text: str = "text",
    chars: int = GROUP_CHARS,
) -> DataFrame:
    """Apply ``fn(columns, texts)`` to groups of rows; a null text is an empty one.

    Only ``columns`` and the text are read. ``fn`` returns one value list per
    column of ``schema``; it may return any number of rows.
    """
    small_batches(df.sparkSession)
    chosen = df.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))

    def run(batches):
        for batch in batches:
            names = batch.schema.names[:-1]
            texts = batch.column(batch.num_columns - 1).to_pylist()
            cols = [c.to_pylist() for c in batch.columns[:-1]]
            for a, b in grouped(texts, chars):
                out = fn({n: c[a:b] for n, c in zip(names, cols, strict=True)}, texts[a:b])
                arrays = [pa.array(v, type=t) if not isinstance(v, pa.Array) else v for v, t in zip(out.values(), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=list(out))
        release()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    types = [f.type for f in to_arrow_schema(_parse_datatype_string(schema))]
    return chosen.mapInArrow(run, schema)


def filter_texts(df: DataFrame, fn: Callable[[list[str]], np.ndarray], text: str = "text", chars: int = GROUP_CHARS) -> DataFrame:
    """Rows of ``df`` for whose text (null: empty) ``fn`` gives True; all columns stay as they are."""
    small_batches(df.sparkSession)
    place = df.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in grouped(texts, chars):
                yield batch.slice(a, b - a).filter(pa.array(fn(texts[a:b])))
        release()

    return df.mapInArrow(run, df.schema)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a newline after each, and the n + 1 begins."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=begins[1:])
    joined = "\n".join(texts) + "\n" if texts else ""
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), begins


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def not_ascii_space(cp: np.ndarray) -> np.ndarray:
    """Mask of ``[^\\x20\\x09-\\x0D]``."""
    return (cp != 32) & ((cp < 9) | (cp > 13))


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (exclusive) of the runs of True."""
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    h = h ^ (h >> np.uint64(29))
    h = h * MIX
    return h ^ (h >> np.uint64(32))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, INVERSE)):
            seq = np.full(size, base, np.uint64)
            seq[0] = 1
            _powers[k] = np.multiply.accumulate(seq)
        if size > 4 * GROUP_CHARS:  # a very long text: do not keep its tables
            out = tuple(_powers)
            _powers[0] = _powers[1] = np.ones(1, np.uint64)
            return out
    return _powers[0], _powers[1]


def span_hashes(cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's code points, equal for equal spans anywhere."""
    up, down = powers(len(cp) + 1)
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(0x51ED27)) * up[: len(cp)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * MIX)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive word hashes; len(words) - size + 1 values."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * BASE + words[k : k + n]
    return mix(h)
