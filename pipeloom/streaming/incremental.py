"""Pipe queries over Structured Streaming inputs.

Every stage compiles to the same DataFrame operations as in batch.  Row-wise stages
stream in append mode; an aggregation streams in update or complete mode.  Stages
that need the whole input in order (ORDER BY, LIMIT, windows, EXCEPT, INTERSECT)
are refused up front.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine, Prepared
from ..errors import AlreadyExists, Unsupported
from ..plans import logical as L
from ..sources.catalog import Append, Catalog


def _nodes(node: L.Node) -> list:
    below = [x for x in (getattr(node, "input", None), getattr(node, "right", None)) if x is not None]
    return [node, *(n for x in below for n in _nodes(x))]


def prepare_stream(engine: Engine, text: str) -> Prepared:
    """Prepare a query whose tables may be streams."""
    prepared = engine.prepare(text)
    for node in _nodes(prepared.plan.root):
        if isinstance(node, (L.Order, L.Limit, L.WindowCount, L.WindowSum)) or isinstance(node, L.SetOperation) and node.kind != "union":
            raise Unsupported(f"{type(node).__name__} over a stream")
    if prepared.plan.order:
        raise Unsupported("an ordered result over a stream")
    return prepared


def run_into_table(engine: Engine, text: str, catalog: Catalog, table: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Append each micro-batch of a row-wise query to a declared table, once even when a batch is replayed."""
    df = prepare_stream(engine, text).dataframe()
    label = name or table

    def write(batch: DataFrame, epoch: int) -> None:
        append = Append(catalog, table)
        append.token = uuid.uuid5(uuid.NAMESPACE_URL, f"{checkpoint}/{label}/{epoch}").hex
        if catalog.resolve(append.token) is None:
            append.directory = f"data/{uuid.uuid4().hex}"  # a replayed batch never meets an earlier attempt's files
            append.write_dataframe(batch)
            append.commit()

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").start()


def run_into_memory(engine: Engine, text: str, name: str, mode: str = "update") -> StreamingQuery:
    """Keep a small result in an in-memory table, for dashboards and tests."""
    if engine.spark.catalog.tableExists(name):
        raise AlreadyExists(f"table {name} exists")
    return prepare_stream(engine, text).dataframe().writeStream.format("memory").queryName(name).outputMode(mode).start()
