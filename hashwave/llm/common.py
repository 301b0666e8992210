"""What the operators share: reading the tables, cutting lineage, words."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashwave.session import shared_dir
from hashwave.sources.files import Folder

#: A word is a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: The folders of the tables that ``written`` gave and that are still in use.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, read back from a table in the cluster's shared folder.

    This cuts the lineage: a later stage that loses an executor reads files instead of
    computing its input again, and a table used twice is computed once.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _folders[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave and that nothing will read any more; other tables are left alone."""
    for table in tables:
        path = _folders.pop(table, None)
        if path:
            Folder(table.sparkSession, path).delete("")


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send at most so many rows to Python at once; the session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def local_shared_dir(spark: SparkSession) -> None:
    """Give a local session without ``spark.checkpoint.dir`` one; a cluster must name its own."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="hashwave-"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies; the folder is installed on every node."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
