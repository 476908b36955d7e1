"""Queries over arriving rectangles. Windows and stabbing tests are stateless, so a stream needs no watermark; what arrives
is not packed until a batch rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def continuous_range_query(stream: DataFrame, box: G.Box) -> DataFrame:
    """Rows of a stream (id, box) that meet ``box``."""
    return stream.filter(F.lit(False) if G.has_nan(box) else G.intersects(G.sides(), G.box_columns(box)))


def continuous_batch_query(stream: DataFrame, queries: DataFrame, most: int = 10_000) -> DataFrame:
    """``qid, id`` of arriving rectangles and standing queries that meet; at most ``most`` queries, which go to every task."""
    if queries.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} standing queries")
    q = queries.select("qid", *(F.col(s).cast("float").alias(f"q_{s}") for s in G.SIDES))
    return stream.join(F.broadcast(q), G.intersects(G.sides(), [F.col(f"q_{s}") for s in G.SIDES])).select("qid", "id")
