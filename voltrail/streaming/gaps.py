"""Gap sessions over a stream of telemetry (an extension: the batch operators are in operators.sequences).

A session is a trip's rows with no pause longer than `pause`; late rows are taken up
to `late` behind. State is one open session a trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(stream: DataFrame, pause: str = "61 seconds", late: str = "10 minutes", trip: str = "trip_id", time: str = "timestamp") -> DataFrame:
    """trip, start, end, rows of each session; works on a batch table as well."""
    d = stream.withWatermark(time, late) if stream.isStreaming else stream
    s = d.groupBy(trip, F.session_window(time, pause).alias("s")).agg(F.count("*").alias("rows"))
    return s.select(trip, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "rows")


def write(sessions_df: DataFrame, path: str, checkpoint: str, every: str = "1 minute") -> StreamingQuery:
    """Appends closed sessions as Parquet."""
    return sessions_df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
