"""Streaming queries against static vectors: each micro-batch is an exact search over the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecmill.operators.exact import knn
from vecmill.sources.vectors import VectorTable


def search_stream(queries: DataFrame, table: VectorTable, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``queries`` is a stream of (vec_id, embedding); ``sink`` gets each batch's neighbours and the batch's number."""

    def batch(df: DataFrame, number: int) -> None:
        rows = VectorTable.of(df, table.form).df
        sink(knn(table, rows, k), number)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
