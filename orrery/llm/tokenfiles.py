"""Token-ID output: Parquet list columns with page indexes, in document order.

Documents are dealt by range of ``key`` (rows of equal keys are told apart by
their place in the input, so a repeated key cannot fill one task), sorted, encoded
and written once. The files hold dictionary-encoded token lists (delta encoding
where a dictionary does not pay), row groups of ``ROW_GROUP_BYTES`` and pages of
``PAGE_ROWS`` rows at most with column and offset indexes, so a reader that wants
a few columns or a range of keys fetches little more than that. Every row carries
its part number and the tokens before it in its part; the global start follows
from the parts' sizes, one row per part, when files are read.

Edge cases: a null text is empty and has only the end id; rows with equal keys
follow one another in input order, null keys come first; an empty table gives
files without rows. Other columns are written only on request (``keep``); one that
bears the name of a column written here is refused.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.bpe import ChunkEncoder
from orrery.llm.shared import new_path
from orrery.llm.text import grouped, small_batches

END_ID = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 2_000
MAX_BROADCAST_PARTS = 100_000


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), end_id: int | None = END_ID) -> None:
    """Write ``docs`` as token files under ``path``, in ascending order of ``key``."""
    if clash := {key, *keep} & {"part", "part_start", "n_tokens", "tokens"} or set(keep) & {key}:
        raise ValueError(f"columns {sorted(clash)} would be written twice")
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    small_batches(docs.sparkSession)
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    rows = docs.select(key, *keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"), F.monotonically_increasing_id().alias("__place"))
    rows = rows.repartitionByRange(key, "__place").sortWithinPartitions(key, "__place")

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        encoder = ChunkEncoder.of(tokenizer)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for a, b in grouped(texts):
                ids = [x + tail for x in encoder.by_words(texts[a:b])]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                ends = np.cumsum(sizes)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)
                own = batch.slice(a, b - a)
                cols = [own.column(i) for i in range(1 + len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(np.full(len(ids), part), pa.int32()), pa.array(before + ends - sizes), pa.array(sizes), lists],
                    names=[key, *keep, "part", "part_start", "n_tokens", "tokens"],
                )
                before += int(ends[-1])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (key, *keep)] + ["part int, part_start long, n_tokens long, tokens array<int>"])
    writer = rows.mapInArrow(run, schema).write
    for name, value in {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
    }.items():
        writer = writer.option(name, value)
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("tokens",), first: int | None = None, last: int | None = None, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ``columns`` of the files; keys from ``first`` to ``last`` if given.

    Starts need only two narrow columns of all rows; the token column is read for
    the wanted keys alone (pushed down to row groups and pages).
    """
    files = spark.read.parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    n_parts = sizes.count()
    # one row per part of the files, not of the documents
    base = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("__base"))
    rows = files
    if first is not None:
        rows = rows.where(F.col(key) >= first)
    if last is not None:
        rows = rows.where(F.col(key) <= last)
    rows = rows.join(F.broadcast(base) if n_parts <= MAX_BROADCAST_PARTS else base, "part")
    return rows.select(key, (F.col("part_start") + F.col("__base")).alias("start"), "n_tokens", *columns)


def with_crc32(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers."""

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            offsets = lists.offsets.to_numpy().astype(np.int64) * 4
            data = np.asarray(lists.values.to_numpy(zero_copy_only=False), "<i4").tobytes()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=[*batch.schema.names[:3], "ids_crc32"])

    kind = dict(tokens.dtypes)[key]
    return tokens.select(key, "start", "n_tokens", "tokens").mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long")


def op6(docs: DataFrame) -> DataFrame:
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return with_crc32(read_tokens(docs.sparkSession, path))
