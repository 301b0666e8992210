"""Sinks. Files are written exactly once: by the checkpoint, or under a name that a batch keeps
when it is run again. The name holds the id of the query, which Spark keeps in the checkpoint: a stream with
a new checkpoint counts its batches from 0 again, but never under the names of another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from hashwave.functions.timing import day_of
from hashwave.operators.geo import geo_uses, hashtag_geo_latest, hashtag_geo_newest
from hashwave.operators.influence import resharer_sketches, reshare_uses, retweet_counts, running_influencers
from hashwave.sources.tables import (
    put_geo_table,
    stored_rows,
    write_people_batch,
    write_count_batch,
    write_interval_counts,
    write_newest_batch,
    write_totals_batch,
)

# Fixed value: how often an idle job looks for new input.
POLL_INTERVAL = "5 minutes"


def _triggered(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    """Every interval, or (None) once over all there is."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def write_batches(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = POLL_INTERVAL,
    files_per_day: int | None = None,
) -> StreamingQuery:
    """Append rows to Parquet, exactly once; rows with a time bucket by day.

    Every task writes the rows it has, so that large days are written by all of them. Where batches
    are small, ``files_per_day`` deals rows out by hashtag into at most so many files for a batch and day.
    """
    writer = rows.writeStream
    if "timebucket" in rows.columns:
        rows = rows.withColumn("date", day_of(F.col("timebucket")))
        if files_per_day is not None:
            rows = rows.repartition("date", F.pmod(F.xxhash64("hashtag", "timebucket"), F.lit(files_per_day)))
        writer = rows.writeStream.partitionBy("date")
    writer = writer.format("parquet").outputMode("append")
    return _triggered(writer.option("checkpointLocation", checkpoint), every).start(path)


def batch_name(batch: DataFrame, batch_id: int) -> str:
    """Names a batch of the running stream for good."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query:
        raise ValueError("only a running stream has batches to name")
    return f"{query}-{batch_id}"


def write_totals(
    totals: DataFrame, path: str, checkpoint: str, every: str | None = POLL_INTERVAL
) -> StreamingQuery:
    """Store the totals that changed in each batch, folded from time to time (see ``tables.read_totals``)."""

    def store(batch: DataFrame, batch_id: int) -> None:
        write_totals_batch(batch, batch_name(batch, batch_id), path)

    writer = totals.writeStream.outputMode("update").foreachBatch(store)
    return _triggered(writer.option("checkpointLocation", checkpoint), every).start()


def accumulate_counts(
    tweets: DataFrame, path: str, checkpoint: str, every: str | None = POLL_INTERVAL
) -> StreamingQuery:
    """Store each batch's own counts, to be added up on reading. Keeps no state at all.

    This is the form for totals that outgrow the cluster's state: late posts count, a batch that
    is run again counts once, and the table can be compacted and continued by any stream.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        write_count_batch(running_influencers(reshare_uses(batch)), batch_name(batch, batch_id), path)

    writer = tweets.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return _triggered(writer, every).start()


def accumulate_geo(
    tweets: DataFrame, path: str, checkpoint: str, bucket: str = "1 second", every: str | None = POLL_INTERVAL
) -> StreamingQuery:
    """Store each batch's newest points by interval, to be folded on reading.

    Keeps no state and waits for no watermark: the last interval is there, and so are late posts,
    as a replay of files in no order of time brings them.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        write_newest_batch(hashtag_geo_newest(geo_uses(batch), bucket), batch_name(batch, batch_id), path)

    writer = tweets.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return _triggered(writer, every).start()


def accumulate_intervals(
    tweets: DataFrame, path: str, checkpoint: str, bucket: str = "15 minutes", every: str | None = POLL_INTERVAL
) -> StreamingQuery:
    """Store each batch's counts by interval, to be added up on reading; complete as :func:`accumulate_geo` is."""

    def store(batch: DataFrame, batch_id: int) -> None:
        write_interval_counts(retweet_counts(reshare_uses(batch), bucket), batch_name(batch, batch_id), path)

    writer = tweets.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return _triggered(writer, every).start()


def accumulate_people(
    tweets: DataFrame, path: str, checkpoint: str, every: str | None = POLL_INTERVAL
) -> StreamingQuery:
    """Store each batch's sketches of the different people who reshare an author, to be united on reading.

    Keeps no state; a sketch has a bounded size, however many people it has seen.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        write_people_batch(resharer_sketches(reshare_uses(batch)), batch_name(batch, batch_id), path)

    writer = tweets.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return _triggered(writer, every).start()


def put_points(
    tweets: DataFrame, path: str, checkpoint: str, bucket: str = "1 second", every: str | None = POLL_INTERVAL
) -> StreamingQuery:
    """Put each batch's points into the served table: keys that a backfill or an earlier batch stored stay as
    they are, so a batch that is run again adds nothing."""

    def store(batch: DataFrame, batch_id: int) -> None:
        put_geo_table(hashtag_geo_latest(geo_uses(batch), bucket), path, batch_name(batch, batch_id))

    writer = tweets.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return _triggered(writer, every).start()


def store_rows(
    rows: DataFrame, path: str, checkpoint: str, order: list[str], every: str | None = POLL_INTERVAL
) -> StreamingQuery:
    """Append rows as :func:`write_batches` does, to a table whose small files are merged as it grows.

    It is read by ``tables.stored_rows``, and its days can be compacted while the stream runs.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def store(batch: DataFrame, batch_id: int) -> None:
        stored_rows(batch.sparkSession, path, schema, order).commit(batch, batch_name(batch, batch_id))

    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return _triggered(writer, every).start()


def live_messages(points: DataFrame) -> DataFrame:
    """Live points as messages: the hashtag as key, the point as JSON value."""
    return points.select(
        F.col("hashtag").alias("key"), F.to_json(F.struct("lat", "lng")).alias("value")
    )


def publish_live(
    points: DataFrame, format: str, checkpoint: str, every: str | None = None, **options: str
) -> StreamingQuery:
    """Send live points to a message sink, such as ``kafka`` with its servers and topic."""
    writer = live_messages(points).writeStream.format(format).outputMode("append")
    writer = writer.options(**options).option("checkpointLocation", checkpoint)
    return _triggered(writer, every).start()
