"""Requests as a stream: every micro-batch is answered like a batch, as routes hold no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine, to_geojson
from ..sources import requests


def answer(engine: Engine, bodies: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Answer a stream of req_id, body (JSON requests) and append GeoJSON rows to a table at path."""

    def batch(df: DataFrame, _: int) -> None:
        to_geojson(engine.routes(requests.multi(df))).write.mode("append").parquet(path)

    return bodies.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
