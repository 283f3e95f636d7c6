"""HL7 message files and archives."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hl7
from ..session import giving_back
from .archives import zipped_files


def parse_messages(df: DataFrame, content: str = "content", keep: Sequence[str] = ()) -> DataFrame:
    """``message`` and ``segments`` of each message text."""
    return df.select(
        *keep,
        hl7.message_line(content).alias("message"),
        hl7.parse_segments(content).alias("segments"),
    )


def read_hl7(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per message file: ``source_file, message, segments``.

    A message file is a few kilobytes, so the whole file is one value.  A file
    without any byte yields no row.
    """
    files = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"), "value"
    )
    return parse_messages(files, "value", keep=["source_file"])


def unzip_messages(
    archives: DataFrame, path: str = "path", content: str = "content", encoding: str = "utf-8"
) -> DataFrame:
    """Members of small zip archives given as values, as ``source_file, content``, unpacked in the tasks.

    ``source_file`` is ``<archive path>/<member name>``.
    """

    @giving_back
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Archives are read where the batch holds them, members some at a time.
            for archive, data in zip(batch.column(0), batch.column(1)):
                with zipfile.ZipFile(pa.BufferReader(data.as_buffer())) as members:
                    names = [n for n in members.namelist() if not n.endswith("/")]
                    for at in range(0, len(names), 1000):
                        part = names[at : at + 1000]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([f"{archive.as_py()}/{n}" for n in part], pa.string()),
                                pa.array([members.read(n).decode(encoding, "replace") for n in part], pa.string()),
                            ],
                            names=["source_file", "content"],
                        )

    return archives.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(
        unpack, "source_file string, content string"
    )


def zipped_messages(archives: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Parsed messages of archives ``path, content``, optionally only the ``wanted`` paths.

    Archives without a wanted member are left out before anything is unpacked.
    """
    if wanted is not None:
        listed = wanted.select(F.col(wanted.columns[0]).alias("source_file")).distinct()
        archive = F.regexp_extract("source_file", r"(?i)^(.*?\.zip)/", 1)
        archives = archives.join(listed.select(archive.alias("path")).distinct(), "path", "left_semi")
    messages = unzip_messages(archives)
    if wanted is not None:
        messages = messages.join(listed, "source_file", "left_semi")
    return parse_messages(messages, "content", keep=["source_file"])


def read_zipped_messages(
    spark: SparkSession, archives: str | Sequence[str], wanted: DataFrame | None = None
) -> DataFrame:
    """Parsed messages of zip archives of any size, optionally only the ``wanted`` paths.

    Members are read by their offsets, see :mod:`reportloom.sources.archives`, which also
    tells those it had to set aside.
    """
    return parse_messages(zipped_files(spark, archives, wanted)[0], "content", keep=["source_file"])
