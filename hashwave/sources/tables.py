"""The served tables as Parquet: geo trend and influencer counts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashwave.functions.text import normalise_tag
from hashwave.functions.timing import day_of
from hashwave.operators.lookups import one_per_key
from hashwave.schemas import GEO_TREND, INFLUENCER
from hashwave.sources.deltas import AppendTable, DeltaTable, FirstTable, GreatestTable, NewestTable, SketchTable

COUNTS = "hashtag string, user_handle string, count bigint"
INTERVAL_COUNTS = f"{COUNTS}, timebucket bigint"
POINTS = "hashtag string, timebucket bigint, lat double, lng double"
NEWEST = "hashtag string, timebucket bigint, moment decimal(38, 0), lat double, lng double"


def write_geo_table(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Store trend rows by day, ordered by hashtag so that a lookup skips most row groups.

    The ranges cover hashtag and time together: a hot hashtag is cut over several files.
    """
    (
        rows.select(*GEO_TREND.fieldNames(), day_of(F.col("timebucket")).alias("date"))
        .repartitionByRange("date", "hashtag", "timebucket")
        .sortWithinPartitions("date", "hashtag", "timebucket")
        .write.option("parquet.bloom.filter.enabled#hashtag", "true")
        .partitionBy("date")
        .mode(mode)
        .parquet(path)
    )


def read_geo_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a plain folder of trend rows, by day or not."""
    return spark.read.schema(GEO_TREND).parquet(path).select(*GEO_TREND.fieldNames())


def served_geo(spark: SparkSession, path: str) -> FirstTable:
    """The table that points are put into: by day, the first commit of a key stays."""
    return FirstTable(spark, path, POINTS, ["hashtag", "timebucket"], ["lat", "lng"], day=day_of(F.col("timebucket")))


def put_geo_table(rows: DataFrame, path: str, batch: str | None = None) -> bool:
    """Put rows whose key may be there: stored ones stay as they are. False if a batch of that name was put before.

    Backfills and streams share this rule, and may put at the same time. Nothing stored is read; a row whose
    key is there already is left out by readers, and dropped when its day is compacted.
    """
    return served_geo(rows.sparkSession, path).commit(one_per_key(rows), batch)


def read_served_geo(spark: SparkSession, path: str, days: list[date] | None = None) -> DataFrame:
    """The points put so far, one per hashtag and interval; of some days, only their files are opened."""
    return served_geo(spark, path).read(None if days is None else [str(day) for day in days])


def compact_days(spark: SparkSession, path: str, days: list[date] | None = None) -> bool:
    """Write each of some days (or of all) as one sorted generation, which readers follow from then on.

    Puts before, meanwhile and afterwards are not lost; False if another compaction was faster.
    """
    return served_geo(spark, path).compact(None if days is None else [str(day) for day in days])


def _newest(spark: SparkSession, path: str) -> NewestTable:
    return NewestTable(spark, path, NEWEST, ["hashtag", "timebucket"], ["moment", "lat", "lng"])


def write_newest_batch(points: DataFrame, batch: str, path: str) -> bool:
    """Commit the newest point of each hashtag and interval that one batch of posts holds."""
    return _newest(points.sparkSession, path).commit(points, batch)


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The geo trend over all committed batches, whatever the order they came in."""
    return _newest(spark, path).read().select(*GEO_TREND.fieldNames())


def compact_newest(spark: SparkSession, path: str) -> None:
    """Fold the committed batches into one in the order of hashtag and time, so that lookups skip row groups."""
    _newest(spark, path).compact()


def _interval_counts(spark: SparkSession, path: str) -> DeltaTable:
    return DeltaTable(spark, path, INTERVAL_COUNTS, ["hashtag", "user_handle", "timebucket"], ["count"])


def write_interval_counts(counts: DataFrame, batch: str, path: str) -> bool:
    """Commit the counts by interval of one batch of posts."""
    return _interval_counts(counts.sparkSession, path).commit(counts, batch)


def read_interval_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts of each hashtag and author in each interval, over all committed batches."""
    return _interval_counts(spark, path).read()


def compact_interval_counts(spark: SparkSession, path: str) -> None:
    _interval_counts(spark, path).compact()


def _counts(spark: SparkSession, path: str) -> DeltaTable:
    return DeltaTable(spark, path, COUNTS, ["hashtag", "user_handle"], ["count"])


def write_count_batch(counts: DataFrame, batch: str | int, path: str) -> bool:
    """Commit the counts of one batch under its name; False if that batch is there already.

    Batches are entered in a log after they are written, so readers see them whole or not at all.
    """
    rows = counts.withColumn("hashtag", normalise_tag(F.col("hashtag")))
    return _counts(counts.sparkSession, path).commit(rows.select(*INFLUENCER.fieldNames()), str(batch))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Totals over all committed batches; a filter on the hashtag is applied to the files."""
    return _counts(spark, path).read()


def compact_counts(spark: SparkSession, path: str) -> None:
    """Fold the committed batches into one, in hashtag order, a hot hashtag over several files.

    Streams may go on writing to the same table, before, meanwhile and afterwards.
    """
    _counts(spark, path).compact()


SKETCHES = "hashtag string, user_handle string, sketch binary"


def _people(spark: SparkSession, path: str) -> SketchTable:
    return SketchTable(spark, path, SKETCHES, ["hashtag", "user_handle"], ["sketch"])


def write_people_batch(sketches: DataFrame, batch: str, path: str) -> bool:
    """Commit the sketches of the people who reshared in one batch of posts."""
    return _people(sketches.sparkSession, path).commit(sketches, batch)


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """One sketch per hashtag and author, over all committed batches."""
    return _people(spark, path).read()


def _totals(spark: SparkSession, path: str) -> GreatestTable:
    return GreatestTable(spark, path, COUNTS, ["hashtag", "user_handle"], ["count"])


def write_totals_batch(totals: DataFrame, batch: str, path: str) -> bool:
    """Commit the running totals that changed in one batch."""
    return _totals(totals.sparkSession, path).commit(totals, batch)


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The newest total of each pair; totals only grow, so it is the greatest."""
    return _totals(spark, path).read()


def stored_rows(spark: SparkSession, path: str, schema: str, order: list[str]) -> AppendTable:
    """A table of rows that all stay, compacted into the given order; with a time bucket it is cut by day."""
    day = day_of(F.col("timebucket")) if "timebucket bigint" in schema else None
    names = [name.split()[0] for name in schema.split(", ")]
    return AppendTable(spark, path, schema, order, [n for n in names if n not in order], day=day)
