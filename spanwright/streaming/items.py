"""The item annotator on a stream of JSON lines: it keeps no state between rows, so the batch plan runs as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..plans.pipelines import Factory, annotate_items


def annotate_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, factory: Factory, turn_sep: str | None = None) -> StreamingQuery:
    """Annotate files of items as they arrive in `source`; every file is processed once, also after a restart."""
    items = spark.readStream.schema(S.ITEM).json(source)
    out = annotate_items(items, factory, turn_sep)
    rows = out.select(F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("value"))
    return rows.writeStream.format("text").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
