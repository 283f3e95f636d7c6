"""Framed message logs: discovery, splitting, naming and manifests.

A log holds many messages between ``<SB>`` and ``<EB>`` lines.  One day's log may
be far larger than an executor, so it is never read as one value.  Lines come
from the splittable text source; where a frame opens and closes is a state
machine over the lines of a file, and the transitions compose.  Each input block
is therefore folded to frames in the task that scans it, for both states it may be
entered with; the few block summaries are chained per file, and the result is joined
back to the frames.  Lines are never shuffled or sorted, only frames.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EMPTY_MESSAGE = "HL7 message content is empty"
NO_MESSAGES = "Log did not contain any HL7 messages"


def log_date(path: Column | str) -> Column:
    """Date in the first run of eight digits of the file name; NULL without one."""
    path = F.col(path) if isinstance(path, str) else path
    name = F.element_at(F.split(path, "/"), -1)
    return F.try_to_date(F.regexp_extract(name, r"(\d{8})", 1), "yyyyMMdd")


def log_stem(path: Column | str) -> Column:
    """File name without its extension."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def message_uri(destination: str, path: Column | str, number: Column | str) -> Column:
    """Where a split message lives: an entry of its log's archive."""
    number = F.col(number) if isinstance(number, str) else number
    stem, day = log_stem(path), log_date(path)
    return F.concat(
        F.lit(destination.rstrip("/") + "/"),
        F.date_format(day, "yyyy"),
        F.lit("/"),
        stem,
        F.lit(".zip/"),
        F.date_format(day, "yyyy/MM/dd"),
        F.lit("/"),
        stem,
        F.lit("_"),
        number.cast("string"),
        F.lit(".hl7"),
    )


def failed_uri(path: Column | str, number: Column | str) -> Column:
    """Placeholder path of a message that could not be stored."""
    number = F.col(number) if isinstance(number, str) else number
    path = F.col(path) if isinstance(path, str) else path
    return F.concat(
        F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("_"), number.cast("string")
    )


def discover_logs(
    spark: SparkSession, paths: str | Sequence[str], date: str | dt.date | None = None
) -> DataFrame:
    """Visible ``.log`` files whose name carries the date.

    Directories are searched recursively.  An explicitly named file need not end
    in ``.log`` but still has to carry the date.  No match at all is an error.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    stamp = str(date).replace("-", "") if date is not None else ""

    def listed(path: str) -> DataFrame:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(path)
            .select(F.col("path").alias("log_path"), F.col("length").alias("bytes"))
        )
        name = F.element_at(F.split("log_path", "/"), -1)
        named = F.col("log_path").endswith(path.rstrip("/")) if path else F.lit(False)
        return files.filter(
            (named | (name.endswith(".log") & ~name.startswith(".")))
            & F.contains(name, F.lit(stamp))
        )

    found = listed(paths[0])
    for path in paths[1:]:
        found = found.unionByName(listed(path))
    found = found.dropDuplicates(["log_path"])
    if found.isEmpty():
        raise FileNotFoundError(f"no log files under {paths} for date {date or 'any'}")
    return found


def read_log_lines(
    spark: SparkSession, paths: str | Sequence[str], date: str | dt.date | None = None
) -> DataFrame:
    """Lines as ``log_path, block, pos, line``; ``(block, pos)`` is file order.

    With a date only files whose name carries it are opened.

    ``block`` is the byte offset of the input block and ``pos`` grows within it.
    The text source hands over raw bytes, which are then decoded as ISO-8859-1.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if date is not None:
        reader = reader.option("pathGlobFilter", f"*{str(date).replace('-', '')}*")
    return (
        reader.text(paths)
        .select(
            F.col("_metadata.file_path").alias("log_path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
            F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"),
        )
    )


class _Fold:
    """Frames of one block as its lines pass, for entering it outside (0) and inside (1) a frame."""

    def __init__(self):
        self.inside, self.opened, self.start = [0, 1], [0, 0], [0, 0]

    def ranges(self, lo: int, hi: int, tags: Sequence[tuple[int, int]]) -> list[tuple[int, int, int | None, int | None]]:
        """Ranges of kept lines among ``lo`` to ``hi`` with their frame's number for either entry."""
        out: list[list] = []

        def put(v: int, end: int) -> None:
            number = self.opened[v] - 1
            if v == 1 and out and out[-1][0] == self.start[1] and out[-1][1] == end and out[-1][3] is None:
                out[-1][3] = number  # the same lines either way
            else:
                out.append([self.start[v], end, *((number, None) if v == 0 else (None, number))])

        self.start = [lo, lo]
        for at, tag in tags:
            for v in (0, 1):
                before = self.inside[v]
                after = 1 - before if tag == 3 else int(tag == 1)
                if after > before:
                    self.opened[v] += 1
                    self.start[v] = at + 1
                elif after < before:
                    put(v, at + 1)
                self.inside[v] = after
        for v in (0, 1):
            if self.inside[v]:
                put(v, hi)
        return [tuple(r) for r in out]


_PIECES = "log_path string, block long, pos long, from_out long, from_in long, lines array<string>"
_STATE = "struct<inside:int,opened:bigint>"
_BLOCKS = f"log_path string, block long, from_out {_STATE}, from_in {_STATE}"


def _fold_lines(summary: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of frames, or with ``summary`` the states in which the blocks end.

    The lines of a block come in order and in one task; a frame is cut where a batch ends.
    """
    state = pa.struct([("inside", pa.int32()), ("opened", pa.int64())])

    def ended(key: tuple, fold: _Fold) -> pa.RecordBatch:
        states = [pa.array([{"inside": i, "opened": n}], state) for i, n in zip(fold.inside, fold.opened)]
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), *states],
            names=["log_path", "block", "from_out", "from_in"],
        )

    key, fold = None, _Fold()
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, blocks = batch.column(0), batch.column(1).to_numpy()
        tags = batch.column(3).to_numpy()
        codes = paths.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
        edges, found = [0, *cuts.tolist(), batch.num_rows], []
        marked = np.flatnonzero(tags)
        for lo, hi in zip(edges, edges[1:]):
            own = (paths[lo].as_py(), int(blocks[lo]))
            if own != key:
                if summary and key is not None:
                    yield ended(key, fold)
                key, fold = own, _Fold()
            mine = marked[np.searchsorted(marked, lo) : np.searchsorted(marked, hi)]
            ranges = fold.ranges(lo, hi, list(zip(mine.tolist(), tags[mine].tolist())))
            found += [(lo, min(start, hi - 1), start, end, a, b) for start, end, a, b in ranges]
        if summary or not found:
            continue
        run, at, start, end, outside, within = zip(*found)
        start, sizes = np.array(start), np.array(end) - np.array(start)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes)
        yield pa.RecordBatch.from_arrays(
            [
                paths.take(pa.array(run)),
                batch.column(1).take(pa.array(run)),
                batch.column(2).take(pa.array(at)),
                pa.array(outside, pa.int64()),
                pa.array(within, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), batch.column(4).take(pa.array(taken, pa.int64()))),
            ],
            names=["log_path", "block", "pos", "from_out", "from_in", "lines"],
        )
    if summary and key is not None:
        yield ended(key, fold)


def _enter_blocks(blocks: DataFrame) -> DataFrame:
    """``log_path, block, entry, opened_before``: the state each block is entered with.

    ``blocks`` has for both possible states at the start of a block the one at its end;
    the blocks of a file are chained, which settles the state and the number of frames
    opened so far.
    """
    entry_type = "array<struct<block:bigint,entry:int,opened_before:bigint>>"

    def chain(state: Column, block: Column) -> Column:
        taken = F.when(state["inside"] == 1, block["from_in"]).otherwise(block["from_out"])
        entry = F.struct(
            block["block"].alias("block"),
            state["inside"].alias("entry"),
            state["opened"].alias("opened_before"),
        )
        return F.struct(
            taken["inside"].alias("inside"),
            (state["opened"] + taken["opened"]).alias("opened"),
            F.concat(state["entries"], F.array(entry)).cast(entry_type).alias("entries"),
        )

    start = F.struct(
        F.lit(0).alias("inside"),
        F.lit(0).cast("bigint").alias("opened"),
        F.array().cast(entry_type).alias("entries"),
    )
    files = blocks.groupBy("log_path").agg(
        F.array_sort(F.collect_list(F.struct("block", "from_out", "from_in"))).alias("blocks")
    )
    return files.select(
        "log_path", F.inline(F.aggregate("blocks", start, chain, lambda state: state["entries"]))
    )


def _frames(lines: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Messages of lines whose blocks each lie in one task, in order, optionally only of ``found`` logs."""
    starts, ends = F.contains("line", F.lit("<SB>")), F.contains("line", F.lit("<EB>"))
    kept = F.replace(F.regexp_replace("line", "<R>$", ""), F.lit("<EB>"), F.lit(""))
    tagged = lines.select(
        "log_path", "block", "pos", F.coalesce(starts.cast("int") + 2 * ends.cast("int"), F.lit(0)).alias("tag"), kept.alias("line")
    )
    entered = _enter_blocks(
        tagged.withColumn("line", F.lit("")).mapInArrow(functools.partial(_fold_lines, True), _BLOCKS)
    )
    if found is not None:
        listed = found.select(same_path("log_path").alias("_path")).distinct()
        entered = entered.join(listed, same_path("log_path") == F.col("_path"), "left_semi")
    pieces = tagged.mapInArrow(functools.partial(_fold_lines, False), _PIECES)
    number = F.when(F.col("entry") == 1, F.col("from_in")).otherwise(F.col("from_out"))
    return (
        # Frames pass by the few rows of their blocks, so that they need not be sorted.
        pieces.join(entered.hint("shuffle_hash"), ["log_path", "block"])
        .withColumn("message_number", F.col("opened_before") + number)
        .filter("message_number IS NOT NULL")
        .groupBy("log_path", "message_number")
        .agg(F.array_sort(F.collect_list(F.struct("block", "pos", "lines"))).alias("pieces"))
        .select("log_path", "message_number", F.flatten(F.col("pieces.lines")).alias("lines"))
    )


def split_frames(lines: DataFrame) -> DataFrame:
    """Messages as ``log_path, message_number, lines`` from log lines in any order.

    A line holding ``<SB>`` opens a frame and is dropped; lines are then kept up
    to and including one holding ``<EB>``, whose tag is removed.  A frame that
    never closes ends with its file.  Anything outside frames is noise.

    A line leaves the open/closed state alone, sets it, or swaps it (both tags on
    one line).  The lines of a block are brought together and ordered first, which
    those just read from files already are: see ``read_message_logs``.
    """
    rows = lines.filter("log_path IS NOT NULL AND block IS NOT NULL")
    return _frames(rows.repartition("log_path", "block").sortWithinPartitions("log_path", "block", "pos"))


def read_message_logs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Messages of framed logs as ``log_path, message_number, lines, log_date``."""
    return _frames(read_log_lines(spark, paths)).withColumn("log_date", log_date("log_path"))


def same_path(path: Column | str) -> Column:
    """Path with one spelling of its scheme; sources differ in the slashes after it."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(path, r"^(\w+):/+", "$1:/")


def read_discovered_logs(
    spark: SparkSession, root: str | Sequence[str], found: DataFrame, date: str | dt.date | None = None
) -> DataFrame:
    """Messages of the ``found`` logs below ``root``; the list stays on the executors.

    Logs found for a date should be read with it, so that no other day is opened.
    """
    lines = read_log_lines(spark, root, date)
    return _frames(lines, found).withColumn("log_date", log_date("log_path"))


def validate_messages(
    messages: DataFrame, logs: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split into usable messages and a quarantine of failed ones.

    ``logs`` (``log_path`` of every file read) adds the files without any frame.
    Quarantine rows are ``file_path, type, status, error_message``.
    """
    has_content = F.exists("lines", lambda line: F.trim(line) != "")
    ok = messages.filter(has_content)
    errors = messages.filter(~has_content).select(
        failed_uri("log_path", "message_number").alias("file_path"),
        F.lit("HL7").alias("type"),
        F.lit("failed").alias("status"),
        F.lit(EMPTY_MESSAGE).alias("error_message"),
    )
    if logs is not None:
        framed = messages.select(same_path("log_path").alias("_path")).distinct()
        errors = errors.unionByName(
            logs.select("log_path")
            .distinct()
            .join(framed, same_path("log_path") == F.col("_path"), "left_anti")
            .select(
                F.col("log_path").alias("file_path"),
                F.lit("Log").alias("type"),
                F.lit("failed").alias("status"),
                F.lit(NO_MESSAGES).alias("error_message"),
            )
        )
    return ok, errors


def message_content(lines: Column | str = "lines") -> Column:
    """Message text with the carriage returns HL7 asks for."""
    return F.concat(F.array_join(lines, "\r"), F.lit("\r"))


def read_manifest(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Message paths listed in manifests; blank lines and unreadable parts are skipped."""
    parts = []
    for path in [paths] if isinstance(paths, str) else paths:
        try:
            parts.append(spark.read.text(path))
        except AnalysisException as error:
            print(f"manifest {path} skipped: {str(error).splitlines()[0]}")
    if not parts:
        return spark.createDataFrame([], "path string")
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.filter(F.trim("value") != "").select(F.col("value").alias("path"))


def write_manifest(df: DataFrame, path: str, column: str = "path") -> None:
    """Write one path per line, as many part files as there are partitions."""
    df.select(F.col(column).cast("string").alias("value")).filter(
        F.trim("value") != ""
    ).write.mode("overwrite").text(path)
