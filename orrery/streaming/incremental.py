"""Incremental extraction: contracts of files as a stream delivers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.contracts import contracts
from orrery.sources.files import fact_table


def contract_stream(files: DataFrame) -> DataFrame:
    """Contracts of a stream of (world, repo_ord, rel, content) rows; stateless, so append mode suffices."""
    return contracts(fact_table(files))


def start(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append contracts to a Parquet table as files arrive; restarts go on from ``checkpoint``."""
    return contract_stream(files).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
