"""Live message feed: keyed stream, durable archive, monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import hl7

# Fixed value: seconds without data that close an archive batch.
BATCH_SECONDS = 30


def keyed(stream: DataFrame, key: str = "key", body: str = "body", watermark=None) -> DataFrame:
    """Messages with their control id as key.

    ``watermark`` is ``(event time column, delay)``; with it a message redelivered
    within the delay is dropped.
    """
    header = hl7.header(hl7.message_line(body))
    out = stream.withColumn(key, hl7.component(header, 10))
    if watermark is None:
        return out
    column, delay = watermark
    return out.withWatermark(column, delay).dropDuplicatesWithinWatermark([key])


def entry_name(key: str = "key", body: str = "body"):
    """Unique archive entry name: the control id and a digest of the message."""
    return F.concat_ws(
        "_", F.col(key).cast("string"), F.substring(F.sha2(F.col(body), 256), 1, 16)
    )


def archive_batch(batch: DataFrame, batch_id: int, path: str, key: str, body: str) -> None:
    """Write one batch and then its manifest; a replay overwrites both."""
    named = batch.filter(F.length(body) > 0).withColumn("entry", entry_name(key, body))
    target = f"{path}/messages/batch={batch_id}"
    named.write.mode("overwrite").parquet(target)
    # Listed from what was written, so the manifest never names a missing entry.
    written = named.sparkSession.read.parquet(target)
    written.select("entry").write.mode("overwrite").parquet(f"{path}/manifest/batch={batch_id}")


def archive_messages(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    key: str = "key",
    body: str = "body",
    interval: str | None = f"{BATCH_SECONDS} seconds",
) -> StreamingQuery:
    """Archive a message stream to parquet with a manifest per batch.

    The source limits the size of a batch (``maxFilesPerTrigger`` or the like),
    ``interval`` its age; without an interval what is there is archived and the
    query ends.  Offsets are committed after the batch is durable; empty bodies
    are skipped but still count as read.
    """
    writer = stream.writeStream.foreachBatch(
        lambda batch, batch_id: archive_batch(batch, batch_id, path, key, body)
    ).option("checkpointLocation", checkpoint)
    writer = (
        writer.trigger(availableNow=True)
        if interval is None
        else writer.trigger(processingTime=interval)
    )
    return writer.start()
