"""Batches of facts that arrive over time, merged into a store by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracelake.schema import NODE_SCHEMA, Graph, empty_graph
from tracelake.sources import store


def merge_nodes(spark: SparkSession, incoming: str, folder: str, progress: str) -> StreamingQuery:
    """Reads node records (JSON files in NODE_SCHEMA) as they appear in `incoming` and merges each micro-batch into the
    store at `folder`.  A batch that is run again after a failure merges to the same graph: equal ids, equal values."""
    none = empty_graph(spark)

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.write(Graph(batch, none.edges, none.evidence), folder)

    rows = spark.readStream.schema(NODE_SCHEMA).json(incoming)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", progress).trigger(availableNow=True).start()
